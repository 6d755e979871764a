"""Small tables with everything that is odd, shared by the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, blk string, kept string, spans string, items string, lines string, edits_ string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(words))


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    base = prose(1, 120)
    long = "\n".join(prose(100 + i, 60) for i in range(500))
    rows = [(1, base), (2, base), (2, base), (3, base.replace(" ", "  \n", 5)), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None), (7, long), (8, long + " more"), (9, "x"), (10, "é中🙂 " * 30), (11, "\n".join([prose(5, 12)] * 4)), (12, prose(5, 12).upper() + "!"), (-3, prose(9, 40))]
    return spark.createDataFrame([(i, t, None, "s" if i and i % 2 else None, None, 7, "z", "b", None, "s", "i", None, None) for i, t in rows], DOCS)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
