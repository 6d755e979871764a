"""Ingest: envelopes against stored documents, as one set-wise merge.

Envelopes of a batch apply in order (``seq``), each seeing what earlier ones of the
same doc_id left; the state before an envelope is therefore the previous envelope
of its doc_id, or else the stored row.  ``action`` of an envelope:

tombstone   it is deleted
unchanged   same hash as the state before, and that state is live
written     anything else

A dry run compares every envelope with the stored row only and changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLASSIFICATIONS, RFC3339, canonical_path, strip


def validation_error(expected_plugin: str | Column) -> Column:
    """The first rule that an envelope breaks, or null."""
    plugin = F.lit(expected_plugin) if isinstance(expected_plugin, str) else expected_plugin
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "schema_version"),
        (~F.coalesce(F.col("source.plugin_id") == plugin, F.lit(False)), "plugin_id"),
        (blank(F.col("document.doc_id")), "doc_id"),
        (blank(F.col("document.content_hash")), "content_hash_empty"),
        (~F.col("document.content_hash").rlike(r"^sha256:[a-f0-9]{64}$"), "content_hash"),
        (~F.coalesce(F.col("document.source_updated_at").rlike(RFC3339) & F.try_to_timestamp(F.upper("document.source_updated_at")).isNotNull(), F.lit(False)), "source_updated_at"),
        (blank(F.col("metadata.doc_type")), "doc_type"),
        (~F.coalesce(F.col("metadata.classification").isin(*CLASSIFICATIONS), F.lit(False)), "classification"),
    ]
    return reduce(lambda w, r: w.when(*_pair(r)), rules[1:], F.when(*_pair(rules[0])))


def _pair(rule: tuple[Column, str]) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[1])


def flatten(envelopes: DataFrame) -> DataFrame:
    """Envelopes (with seq) as flat rows, with the path that a new document would get."""
    return envelopes.select(
        "seq", "document.doc_id", "source.plugin_id", "source.connector_instance", "source.external_id", "source.uri", "document.title", "metadata.doc_type", "metadata.classification",
        "document.content_hash", "document.source_updated_at", F.coalesce("document.deleted", F.lit(False)).alias("deleted"), "document.markdown",
        F.to_json(F.coalesce("metadata.tags", F.array().cast("array<string>"))).alias("tags_json"), "metadata.language",
        F.to_json(F.coalesce("metadata.acl_tags", F.array().cast("array<string>"))).alias("acl_tags_json"), F.coalesce("metadata.frontmatter_json", F.lit("{}")).alias("frontmatter_json"),
        canonical_path(F.col("metadata.classification"), F.col("source.plugin_id"), F.col("source.connector_instance"), F.col("document.doc_id")).alias("markdown_path"),
    )


def actions(batch: DataFrame, stored: DataFrame, dry_run: bool = False) -> DataFrame:
    """``batch`` (seq, doc_id, content_hash, deleted, ...) with nth (1 for a doc_id's first), action and file_removed.

    stored: doc_id, content_hash, deleted; one row per doc_id.
    """
    old = stored.select(F.col("doc_id").alias("_id"), F.col("content_hash").alias("_hash"), (~F.coalesce("deleted", F.lit(False))).alias("_live"))
    own = Window.partitionBy("doc_id").orderBy("seq")
    rows = batch.join(old, F.col("doc_id") == F.col("_id"), "left").withColumn("nth", F.row_number().over(own))
    if dry_run:
        before_hash, before_live = F.col("_hash"), F.coalesce("_live", F.lit(False))
    else:
        before_hash = F.when(F.col("nth") == 1, F.col("_hash")).otherwise(F.lag("content_hash").over(own))
        before_live = F.when(F.col("nth") == 1, F.coalesce("_live", F.lit(False))).otherwise(~F.lag("deleted").over(own))
    rows = rows.withColumn("_before", before_hash).withColumn("_alive", before_live)
    same = F.coalesce(F.col("_before") == F.col("content_hash"), F.lit(False)) & F.col("_alive")
    action = F.when(F.col("deleted"), F.lit("tombstone")).when(same, F.lit("unchanged")).otherwise(F.lit("written"))
    return rows.withColumn("action", action).withColumn("file_removed", F.col("deleted") & F.col("_alive")).drop("_id", "_hash", "_live", "_before", "_alive")


def counters(acted: DataFrame) -> DataFrame:
    """processed, written, unchanged, tombstoned, deleted_files, duplicate_doc_ids: one row."""
    n = lambda c: F.count_if(c)
    return acted.agg(
        F.count("*").alias("processed"), n(F.col("action") == "written").alias("written"), n(F.col("action") == "unchanged").alias("unchanged"),
        n(F.col("action") == "tombstone").alias("tombstoned"), n("file_removed").alias("deleted_files"), n(F.col("nth") > 1).alias("duplicate_doc_ids"),
    )


def changing(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id of the batch's documents that end otherwise than they are stored, in anything but times and paths; bodies are compared by their hash."""
    columns = [c for c in stored.columns if c not in ("doc_id", "created_at", "updated_at", "markdown_path", "markdown") and c in batch.columns]
    last = batch.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.struct(F.col("seq").cast("long").alias("_seq"), *columns)).alias("_last"))
    joined = last.join(stored.select("doc_id", *columns), F.col("_id") == F.col("doc_id"), "left")
    same = reduce(lambda a, b: a & b, (F.col(f"_last.{c}").eqNullSafe(F.col(c)) for c in columns), F.col("doc_id").isNotNull())
    return joined.where(~same).select(F.col("_id").alias("doc_id"))


def latest(stored: DataFrame, batch: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """The batch's documents as they are to be stored: the last row of each key, created_at and markdown_path as they were first.

    A batch's rows are reduced to the last of each key and its first path by one
    aggregate; the stored rows of these keys lend only created_at and markdown_path, so
    that no stored body is read.  Sequence numbers order the rows of a batch
    among themselves, and may be of any sign.
    """
    columns = [c for c in stored.columns if c not in ("created_at", "updated_at")]
    row = F.struct(F.col("seq").cast("long").alias("_seq"), *columns)
    new = batch.groupBy(F.col(key).alias("_key")).agg(F.max(row).alias("_last"), *([F.min(F.struct(F.col("seq").cast("long").alias("_seq"), "markdown_path")).alias("_first")] if "markdown_path" in columns else []))
    old = stored.select(F.col(key).alias("_old"), F.col("created_at").alias("_created"), *([F.col("markdown_path").alias("_path")] if "markdown_path" in columns else []))
    new = new.join(old, F.col("_key") == F.col("_old"), "left")
    kept = {c: F.col(f"_last.{c}") for c in columns} | {"created_at": F.coalesce("_created", now), "updated_at": now}
    if "markdown_path" in columns:
        kept["markdown_path"] = F.when(F.col("_old").isNotNull(), F.col("_path")).otherwise(F.col("_first.markdown_path"))
    return new.select(*(kept[c].alias(c) for c in stored.columns))


def merge(stored: DataFrame, batch: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """The stored rows after the batch.  Rows of other keys pass through an anti-join on the batch's keys, without a sort of bodies, and without a shuffle while the keys are few."""
    rest = stored.join(batch.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")
    return rest.select(*stored.columns).unionByName(latest(stored, batch, now, key))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` replace stored rows of the same keys (index state, blobs)."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch.select(*stored.columns))
