"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns
is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).

1. quality classifier: documents whose score is below the threshold go.
2. line dedup: later occurrences of like lines go; a document left without any
   text, though it had some, goes.
3. MinHash near-dedup: of each group of near copies the least doc_id stays.
4. benchmark decontamination: documents that hold a benchmark window go.
5. packing: the rest become sequences of at most 4096 tokens; one row per piece,
   with its token ids.

Odd input: a null text has no words, goes only if the classifier rejects it, stays null
up to packing, and is packed as its end id; a null doc_id is compared with none by stages
2 and 3 and kept; ties and repeated rows: as each stage's operator states; an empty table
gives no row; further columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import decontaminate, lines, order_minhash, packing, quality
from lodeseam.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = order_minhash.near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.length("spans") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: a learned network, links of like lines and documents, and a tokenizer are beyond it; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
