"""Catalogue: topics, books, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def string_list(json_text: Column) -> Column:
    """A JSON array of strings only, else null (a plain parse would turn numbers into text)."""
    items = F.from_json(json_text, "array<variant>")
    kinds = F.transform(items, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    return F.when(F.forall(kinds, lambda k: k == "STRING"), F.from_json(json_text, "array<string>"))


#: Columns whose distinct values are estimated, and the sketches' size (2 ** LG registers: about 1.6 %).
DISTINCT, LG = {"contents": "content_hash", "sources": "connector_instance", "titles": "title"}, 12


def _tags() -> Column:
    return F.array_distinct(F.filter(F.transform(string_list(F.col("tags_json")), strip), lambda t: t != ""))


def topic_counts(documents: DataFrame) -> DataFrame:
    """classification, tag, n of live documents: partial counts, which add up over any parts of the documents, and subtract."""
    live = documents.where("NOT coalesce(deleted, false)")
    return live.select("classification", F.explode(_tags()).alias("tag")).groupBy("classification", "tag").agg(F.count("*").alias("n"))


def topics_from_counts(counts: DataFrame, classification: str | None = None) -> DataFrame:
    """What ``browse_topics`` gives, from partial counts."""
    rows = counts if classification is None else counts.where(F.col("classification") == classification)
    return rows.groupBy("tag").agg(F.sum("n").alias("doc_count")).where("doc_count > 0").orderBy(F.desc("doc_count"), "tag")


def distinct_sketches(documents: DataFrame, part: Column) -> DataFrame:
    """part, what, sketch of live documents: sketches of distinct values, which merge over parts."""
    live = documents.where("NOT coalesce(deleted, false)").withColumn("part", part)
    each = live.groupBy("part").agg(*(F.hll_sketch_agg(F.coalesce(F.col(c), F.lit("")), LG).alias(what) for what, c in DISTINCT.items()))
    return each.select("part", F.explode(F.array(*(F.struct(F.lit(w).alias("what"), F.col(w).alias("sketch")) for w in DISTINCT))).alias("s")).select("part", "s.what", "s.sketch")


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """what, n: estimates over all parts."""
    return sketches.groupBy("what").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def browse_topics(documents: DataFrame, classification: str | None = None) -> DataFrame:
    """tag, doc_count of live documents, most frequent first; a document counts once per tag."""
    live = documents.where("NOT coalesce(deleted, false)")
    if classification is not None:
        live = live.where(F.col("classification") == classification)
    return live.select(F.explode(_tags()).alias("tag")).groupBy("tag").agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "tag")


def list_books(routed: DataFrame, state: DataFrame) -> DataFrame:
    """doc_id, title, chunk_count and, if documents have paths, file of live books by title; no known count is 0."""
    counts = state.where("status = 'indexed' AND chunk_count >= 0").select(F.col("doc_id").alias("_doc"), F.col("embedding_profile_id").alias("_profile"), "chunk_count")
    books = routed.where("NOT coalesce(deleted, false) AND doc_type = 'book'")
    joined = books.join(counts, (F.col("doc_id") == F.col("_doc")) & (F.col("embedding_profile_id") == F.col("_profile")), "left")
    file = [F.col("markdown_path").alias("file")] if "markdown_path" in routed.columns else []
    return joined.select("doc_id", "title", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), *file).orderBy("title", "doc_id")


def counts_by_type(documents: DataFrame) -> DataFrame:
    """doc_type, n of live documents, and a row of null type with the total."""
    return documents.where("NOT coalesce(deleted, false)").rollup("doc_type").agg(F.count("*").alias("n"))
