"""Retrieval: postings and BM25, vector scores, reciprocal rank fusion, filters, grouping.

Units of retrieval are rows with a key (a chunk, or a whole document); every
ranking breaks ties by key, so that results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import tokens
from ..functions.frontmatter import scalar_text
from ..functions.text import instant

# --- fixed values -------------------------------------------------------------
K1, B = 1.2, 0.75
RRF_K = 60
OVERFETCH, MOST_CANDIDATES = 5, 500
THRESHOLD, TOP_K = 0.3, 25
# -------------------------------------------------------------------------------


class Mode(str, Enum):
    KEYWORD, SEMANTIC, HYBRID = "keyword", "semantic", "hybrid"

    @classmethod
    def parse(cls, text: str) -> Mode:
        try:
            return cls(text.lower())
        except ValueError:
            raise ValueError(f"unknown search mode '{text}'; expected one of: {', '.join(m.value for m in cls)}") from None


def candidates(top_k: int = TOP_K, limit: int = TOP_K) -> int:
    """Hits to fetch per profile before filters."""
    return min(max(top_k * OVERFETCH, limit * OVERFETCH), MOST_CANDIDATES)


# ---------------------------------------------------------------- keyword


def postings(rows: DataFrame, keys: list[str], text: str, analyse=tokens) -> DataFrame:
    """keys, token, tf, dl: the inverted index of ``rows``; dl is the row's length in tokens.

    One shuffle: token counts are combined map-side under the key, and the length is
    taken from the row before it is exploded.
    """
    words = rows.select(*keys, analyse(F.col(text)).alias("_w")).withColumn("dl", F.size("_w"))
    return words.select(*keys, "dl", F.explode("_w").alias("token")).groupBy(*keys, "dl", "token").agg(F.count("*").alias("tf"))


def corpus_stats(rows: DataFrame, text: str, analyse=tokens) -> DataFrame:
    """n, avgdl: one row."""
    return rows.select(F.size(analyse(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def bm25(rows: DataFrame, keys: list[str], text: str, query: str, analyse=tokens) -> DataFrame:
    """keys, score of every row with a query term.

    Lengths and the query's term counts come from the token array, without an exploded
    index; df of the terms and the corpus size are one aggregate, joined back as a
    single row.  Rows that don't even hold a term as a substring are not split.  The
    last filter is on the score, which needs that row: Catalyst would push one on the
    counts below the projection, and split the text once per term.
    """
    spark = rows.sparkSession
    terms = spark.range(1).select(F.explode(F.array_distinct(analyse(F.lit(query)))).alias("t")).agg(F.sort_array(F.collect_list("t")).alias("t")).first()["t"]

    def counted(part: DataFrame) -> DataFrame:
        words = part.select(*keys, analyse(F.col(text)).alias("_w"))
        return words.select(*keys, F.size("_w").alias("dl"), *(_occurrences("_w", t).alias(f"tf{i}") for i, t in enumerate(terms)))

    n = range(len(terms))
    stats = counted(rows).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in n))
    some = rows.where(reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t)) for t in terms), F.lit(False))) if analyse is tokens else rows
    parts = [bm25_term(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("dl"), F.col("avgdl")) for i in n]
    scored = counted(some).crossJoin(F.broadcast(stats)).select(*keys, reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"))  # one row
    return scored.where(F.col("score") > 0)


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25_term(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    """What one term adds to a row's score; it grows with tf, and falls with dl."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_from_index(index: DataFrame, stats: DataFrame, frequencies: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, score from stored postings; filters on token reach the scan, and postings sorted by token are skipped by their ranges."""
    hits = index.where(F.col("token").isin(terms))
    df = frequencies.where(F.col("token").isin(terms))
    scored = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # a row per term; one row
    return scored.groupBy(*keys).agg(F.sum(bm25_term(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))).alias("score"))


# ---------------------------------------------------------------- semantic


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    squares = F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    if metric not in ("l2", "l2sq"):
        raise ValueError(f"unknown metric {metric}")
    return F.sqrt(squares) if metric == "l2" else squares


class SearchError(RuntimeError):
    pass


def query_vector(embed: Callable[[list[str]], list[list[float]]], query: str, mode: Mode) -> list[float] | None:
    """The query's vector, or null where there is to be none: hybrid search falls back to keywords if the embedder fails.  A reply without a vector is an error of its own."""
    if mode is Mode.KEYWORD:
        return None
    try:
        vectors = embed([query])
    except Exception:
        if mode is Mode.SEMANTIC:
            raise
        return None
    if not len(vectors) or not len(vectors[0]):
        raise SearchError("the embedder returned an empty vector")
    return vectors[0]


def semantic(rows: DataFrame, keys: list[str], vector: str, query: list[float], metric: str = "l2") -> DataFrame:
    """keys, score = exp(-distance) of every row with a vector."""
    return rows.where(F.col(vector).isNotNull()).select(*keys, F.exp(-distance(F.col(vector), query, metric)).alias("score"))


# ---------------------------------------------------------------- ranking


def top(hits: DataFrame, keys: list[str], n: int, score: str = "score") -> DataFrame:
    """The n best, ties by key; a top-k per partition, then of those."""
    return hits.orderBy(F.desc(score), *keys).limit(n)


def ranked(hits: DataFrame, keys: list[str], n: int) -> DataFrame:
    best = top(hits, keys, n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)))  # over n rows


def fuse(keyword: DataFrame, vector: DataFrame, keys: list[str], n: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings; a hit of one arm alone counts with that arm."""
    a = ranked(keyword, keys, n).select(*keys, F.col("rank").alias("ra"))
    b = ranked(vector, keys, n).select(*keys, F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    return a.join(b, keys, "full").select(*keys, (part("ra") + part("rb")).alias("score"))


def rounded(score: Column) -> Column:
    return F.round(score, 4)


# ---------------------------------------------------------------- filters


@dataclass
class SearchFilter:
    """Conjunctive predicate on document rows; the default accepts every live document."""

    doc_type: str | None = None
    classification: str | None = None
    path_includes: list[str] = field(default_factory=list)
    path_excludes: list[str] = field(default_factory=list)
    since: str | None = None
    frontmatter: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.since is not None:
            datetime.fromisoformat(self.since.replace("Z", "+00:00"))

    def predicate(self) -> Column:
        parts = [~F.coalesce(F.col("deleted"), F.lit(False))]
        if self.doc_type is not None:
            parts.append(F.col("doc_type") == self.doc_type)
        if self.classification is not None:
            parts.append(F.col("classification") == self.classification)
        if self.path_includes:
            parts.append(reduce(lambda a, b: a | b, (F.contains(F.col("external_id"), F.lit(p)) for p in self.path_includes)))
        parts += [~F.contains(F.col("external_id"), F.lit(p)) for p in self.path_excludes]
        if self.since is not None:
            parts.append(F.coalesce(instant(F.col("source_updated_at")) >= instant(F.lit(self.since)), F.lit(False)))
        parts += [F.coalesce(scalar_text(F.col("frontmatter_json"), k) == v, F.lit(False)) for k, v in sorted(self.frontmatter.items())]
        return reduce(lambda a, b: a & b, parts)


def attach(hits: DataFrame, documents: DataFrame, where: SearchFilter | None = None) -> DataFrame:
    """Hits with their live documents that pass the filter; hits of a search, of which all are joined (Spark broadcasts them if they are few, as candidates are)."""
    return documents.join(hits, "doc_id").where((where or SearchFilter()).predicate())


def chunk_results(hits: DataFrame, limit: int) -> DataFrame:
    """Best first, one row per (file, text); a limit of 0 still gives one row."""
    same = Window.partitionBy("file", "text").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "doc_id", "text").limit(max(limit, 1))


def document_results(hits: DataFrame, limit: int) -> DataFrame:
    """One row per document: its best hit, and chunk_count, its hits before the limit."""
    own = Window.partitionBy("doc_id")
    best = hits.withColumn("chunk_count", F.count("*").over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "text")))
    return best.where("_n = 1").drop("_n").orderBy(F.desc("score"), "doc_id").limit(limit)
