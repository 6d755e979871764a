"""Keyword search that skips blocks of postings which can't hold a result.

Documents are dealt into ranges of about ``SIZE``: by their length in bands, and
within a band by a hash.  A block is what a token has in a range: its postings, the
greatest term frequency and the least length.  With these two a block's BM25 impact is
bounded for any corpus statistics, so that blocks outlive changes of n, df and the
average length.

A search sums the bounds of its terms' blocks per range, without reading
postings; scores the ranges of the greatest bounds for a floor that the result
can't fall below; and then reads the blocks of those ranges only whose bound reaches
the floor.  The result is exactly that of scoring every posting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import retrieval as R

#: Documents of a range, and length bands per doubling.
SIZE, BANDS = 64, 4


def row_words(rows: DataFrame, keys: list[str], text: str, analyse=R.tokens, terms: list[str] | None = None) -> DataFrame:
    """keys, dl, words: the length of every row in tokens, and its tokens (of ``terms`` alone, if given). Whoever reads it more than once writes it."""
    split = rows.select(*keys, analyse(F.col(text)).alias("_w"))
    held = F.col("_w") if terms is None else F.filter("_w", lambda t: t.isin(terms))
    return split.select(*keys, F.size("_w").alias("dl"), held.alias("words"))


def block_index(words: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """token, range, max_tf, min_dl, n, postings (keys, tf, dl), in the order of tokens and ranges.

    words: keys, dl, words of every row (``row_words``), written already.  Rows are shuffled once, by their
    range: counts of tokens and their blocks need no other exchange, as each row lies whole in its range.
    The counts of bands, which the driver collects, are at most some BANDS * 64.
    """
    band = F.when(F.col("dl") > 0, F.floor(F.log2("dl") * BANDS)).otherwise(-1).cast("int")
    counts = {r.band: r.n for r in words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    first, parts, at = {}, {}, 0
    for b in sorted(counts):
        first[b], parts[b] = at, max(1, math.ceil(counts[b] / size))
        at += parts[b]
    if not counts:
        first, parts = {0: 0}, {0: 1}
    look = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))[band]
    place = (look(first) + F.pmod(F.xxhash64(*keys), look(parts)).cast("int")).alias("range")
    dealt = words.where(F.size("words") > 0).select(*keys, "dl", "words", place).repartition("range")
    counted = dealt.select("range", *keys, "dl", F.explode("words").alias("token")).groupBy("range", *keys, "dl", "token").agg(F.count("*").alias("tf"))
    blocks = counted.groupBy("token", "range").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").alias("n"), F.collect_list(F.struct(*keys, "tf", "dl")).alias("postings"))
    # the bounds of a range partitioning are sampled from its input, which would be aggregated twice if it weren't written
    return written(blocks, "unsorted").repartitionByRange("token", "range").sortWithinPartitions("token", "range")


def corpus(words: DataFrame) -> DataFrame:
    """n, avgdl: one row, of what ``row_words`` counted."""
    return words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies_of(blocks: DataFrame) -> DataFrame:
    """token, df; postings are not read."""
    return blocks.groupBy("token").agg(F.sum("n").alias("df"))


def _weighted(blocks: DataFrame, stats: DataFrame, frequencies: DataFrame, terms: list[str]) -> DataFrame:
    """The terms' blocks with df, n_rows, avgdl: a row per term and a single row are broadcast."""
    df = frequencies.where(F.col("token").isin(terms))
    return blocks.where(F.col("token").isin(terms)).join(F.broadcast(df), "token").crossJoin(F.broadcast(stats.select(F.col("n").alias("n_rows"), "avgdl")))


def bounds(blocks: DataFrame, stats: DataFrame, frequencies: DataFrame, terms: list[str]) -> DataFrame:
    """range, bound: no row of the range scores more; postings are not read."""
    most = R.bm25_term(F.col("max_tf"), F.col("df"), F.col("n_rows"), F.col("min_dl"), F.col("avgdl"))
    return _weighted(blocks.drop("postings"), stats, frequencies, terms).groupBy("range").agg(F.sum(most).alias("bound"))


def scores(blocks: DataFrame, stats: DataFrame, frequencies: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, score of every posting of the blocks."""
    hits = _weighted(blocks, stats, frequencies, terms).select("df", "n_rows", "avgdl", F.explode("postings").alias("p"))
    part = R.bm25_term(F.col("p.tf"), F.col("df"), F.col("n_rows"), F.col("p.dl"), F.col("avgdl"))
    return hits.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys)).agg(F.sum(part).alias("score"))


def reaching(blocks: DataFrame, stats: DataFrame, frequencies: DataFrame, keys: list[str], terms: list[str], n: int, seed: int | None = None) -> DataFrame:
    """The terms' blocks of ranges that may hold one of the n best rows."""
    heads = bounds(blocks, stats, frequencies, terms).persist()
    try:
        best = heads.orderBy(F.desc("bound"), "range").limit(seed or max(4, math.ceil(2 * n / SIZE))).select("range")
        least = R.top(scores(blocks.join(F.broadcast(best), "range", "left_semi"), stats, frequencies, keys, terms), keys, n).agg(F.count("*").alias("n"), F.min("score").alias("floor")).first()
    finally:
        heads.unpersist()
    # sums of a row's parts and of bounds may round differently
    floor: Column = F.lit(least.floor * (1 - 1e-9) if least.n == n else 0.0)
    return blocks.where(F.col("token").isin(terms)).join(heads.where(F.col("bound") >= floor).select("range"), "range", "left_semi")


def block_max_top(blocks: DataFrame, stats: DataFrame, frequencies: DataFrame, keys: list[str], terms: list[str], n: int, seed: int | None = None) -> DataFrame:
    """keys, score of the n best rows, ties by key: those of ``bm25_from_index`` and ``top``."""
    if n <= 0 or not terms:
        return R.top(scores(blocks.limit(0), stats, frequencies, keys, terms), keys, 0)
    return R.top(scores(reaching(blocks, stats, frequencies, keys, terms, n, seed), stats, frequencies, keys, terms), keys, n)
