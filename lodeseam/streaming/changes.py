"""Change detection on a stream of envelopes, with state per document.

State of a doc_id is the sequence number, the digest and the kind of its latest row.  A
row with a greater number is a change, unless all its columns are as before; rows that
come late or again change nothing.  So the last change of each document is what a
batch merge of the same rows would leave, in whatever order they come.

A tombstone's state is kept for ``keep`` of event time after the watermark passed it, and then forgotten by
a timer, so that state grows with live documents only.  ``keep`` covers the rows that the
watermark still lets in, so that none of them can bring a document back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: State stores that keep state on disk and in the checkpoint, which stateful processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("seq", LongType()), StructField("digest", LongType()), StructField("gone", BooleanType())])


class _Latest(StatefulProcessor):
    def __init__(self, columns: list[str], keep_ms: int) -> None:
        self.columns, self.keep = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:  # the greatest number; of rows with equal ones the greatest digest, whatever their order
            top = batch.sort_values(["seq", "digest"]).iloc[-1]
            if best is None or (top["seq"], top["digest"]) > (best["seq"], best["digest"]):
                best = top
        old = self.state.get() if self.state.exists() else None
        number, digest, gone = int(best["seq"]), int(best["digest"]), bool(best["deleted"])
        if old is not None and (number, digest) <= (old[0], old[1]):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if gone:
            self.handle.registerTimer(max(int(best["at"].timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep)
        self.state.update((number, digest, gone))
        if old is None or old[1] != digest:
            yield pd.DataFrame([best[self.columns]], columns=self.columns).assign(change="tombstone" if gone else "new" if old is None or old[2] else "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def detect_changes(rows: DataFrame, late: str = "1 hour", keep: str | None = None) -> DataFrame:
    """The rows (doc_id, seq, at, deleted, and more) of a stream that change their document, with ``change``: new, changed or tombstone.

    at: event time; rows more than ``late`` behind the latest are dropped.  A tombstone's state is kept for ``keep``, at least ``late``.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own, least = (int(spark.range(1).select(F.expr(f"timestampdiff(MILLISECOND, timestamp'1970-01-01 00:00:00Z', timestamp'1970-01-01 00:00:00Z' + interval {x})")).first()[0]) for x in (keep or late, late))
    # times and numbers that merely say when a row was written are no change
    content = [c for c in rows.columns if c not in ("doc_id", "seq", "at")]
    ready = rows.where("doc_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("digest", F.xxhash64(*content)).withWatermark("at", late)
    schema = StructType([*rows.schema.fields, StructField("change", rows.schema["doc_id"].dataType)])
    return ready.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=_Latest(rows.columns, max(own, least)), outputStructType=schema, outputMode="Update", timeMode="EventTime")
