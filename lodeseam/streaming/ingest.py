"""Continuous ingest: envelopes that land as JSON files, merged batch by batch.

A batch is one merge (see operators.ingest); the order within a batch is the
landing file's time, then its path, then the doc_id.  A repeated batch, as after a
lost driver, merges the same rows again and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import ENVELOPE


def read_landing(spark, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The envelopes of a landing folder as a stream, with ``seq``."""
    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.withColumn("seq", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("document.doc_id").alias("id")))


def start(engine, folder: str, checkpoint: str, index: bool = False, **trigger) -> StreamingQuery:
    """Starts the ingest; ``trigger`` as for ``writeStream.trigger`` (by default what is there, then it stops)."""

    def merge(batch: DataFrame, _: int) -> None:
        engine.ingest(_numbered(batch))
        if index:
            engine.index()

    return read_landing(engine.spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _numbered(batch: DataFrame) -> DataFrame:
    """seq as a number that orders the envelopes of each doc_id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("document.doc_id").orderBy("seq"))
    return batch.withColumn("_n", n).withColumn("seq", F.col("_n").cast("long")).drop("_n")
