"""Hard-negative mining with a vector-approximation file.

Every row takes part in a search of all anchors, in blocks: rows are dealt by their id
into shards of about ``SHARD`` rows, anchors into blocks of at most ``BLOCK``, and each block
visits every shard.

1. A shard is its own approximation file: each dimension is quantised into up to 256 cells of
   about equal counts; a row keeps one byte per dimension, and each cell its least and
   greatest value.  Rows are ordered by label.
2. For an anchor, a table per dimension gives the least and greatest product of every
   cell; their sums over a row's cells bound the row's score from below and above.
3. Positives: among rows of the anchor's label, those whose upper bound reaches the
   k-th greatest lower bound are scored exactly.  Negatives: of the other labels, those whose bounds
   meet a window; where k rows lie in it for certain, only what may surpass the least of them.
4. A shard's best are merged over all shards by a ranking that Spark limits before the shuffle.

A visit streams through a task: a shard's rows first, then one anchor block after
another, so that a task holds one shard and one block whatever the table's size.  Scores are
integers: results are exact, and ties go to the smaller vec_id.

Odd input: rows with a null vec_id, label or vector, with a null or non-finite component, or of another
length than the commonest take no part, nor do vectors whose scaled squares exceed 2**52, so that every sum
is exact; of rows that repeat a vec_id the smallest (vector, label) counts; anchors without a row of their label give no rows,
nor does a window that no row meets; an empty table gives no rows; other columns are
not looked at.  Zero vectors take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, tidy

SHARD, BLOCK, CELLS = 4096, 256, 256
#: Positives of an anchor, negatives of a pair, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


def usable(vectors: DataFrame, label: Column, scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, v array<long>, scaled and floored) of the rows that take part, and the length of v."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0].n if sizes else 1
    square = F.aggregate("x", F.lit(0.0), lambda total, c: total + F.floor(c * scale).cast("double") * F.floor(c * scale).cast("double"))
    rows = rows.where((F.size("x") == dim) & (square <= float(1 << 52))).groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r"))
    return rows.select("vec_id", F.col("r.label").alias("label"), F.transform("r.x", lambda c: F.floor(c * scale)).alias("v")), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), dim)


class File:
    """The approximation file of a shard, ordered by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        n, dim = vectors.shape
        self.codes, self.least, self.most = np.zeros((dim, n), np.uint8), np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64)
        for d in range(dim):
            values = self.vectors[:, d]
            marks = np.unique(np.sort(values)[(np.arange(1, CELLS) * n) // CELLS]) if n else values
            self.codes[d] = code = np.searchsorted(marks, values, "right")
            by_code = np.argsort(code, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(code[by_code]) != 0))[: max(n, 1)] if n else np.zeros(0, np.int64)
            if n:
                self.least[d, code[by_code][at]] = np.minimum.reduceat(values[by_code], at)
                self.most[d, code[by_code][at]] = np.maximum.reduceat(values[by_code], at)
        self.scored = self.seen = 0

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each row, by table lookup."""
        a, b = anchor[:, None] * self.least, anchor[:, None] * self.most
        low, high = np.minimum(a, b), np.maximum(a, b)
        n = rows.stop - rows.start
        least, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(len(anchor)):
            code = self.codes[d, rows]
            least += low[d].take(code)
            most += high[d].take(code)
        self.seen += n
        return least, most

    def best(self, anchor: np.ndarray, rows: np.ndarray, k: int, low: int, high: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows with a score in [low, high]."""
        scores = self.vectors[rows] @ anchor
        self.scored += len(rows)
        fine = (scores >= low) & (scores <= high)
        rows, scores = rows[fine], scores[fine]
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(self.ids[rows[top]].tolist(), scores[top].tolist(), strict=True))

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value; less than any score if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -(1 << 62)


def positives(file: File, ids: list[int], labels: list[int], vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, row, score): candidates of the shard for each anchor's k best of its label."""
    for anchor, label, v in zip(ids, labels, vectors, strict=True):
        rows = file.own(label)
        if rows.stop == rows.start:
            continue
        low, high = file.bounds(v, rows)
        other = file.ids[rows] != anchor
        floor = _kth(low[other], k)
        chosen = np.flatnonzero(other & (high >= floor)) + rows.start
        for row, score in file.best(v, chosen, k, -(1 << 62), 1 << 62):
            yield anchor, row, score


def negatives(file: File, ids: list[int], labels: list[int], vectors: np.ndarray, found: list[list[dict]], k: int, window: tuple[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, positive, positive score, row, score): candidates of the shard for the k best of another label within each positive's window."""
    everything = slice(0, len(file.ids))
    for anchor, label, v, pairs in zip(ids, labels, vectors, found, strict=True):
        windows = [(p["vec_id"], p["score"], -(-window[0] * p["score"] // 100), window[1] * p["score"] // 100) for p in pairs]
        windows = [w for w in windows if w[2] <= w[3]]
        if not windows or not len(file.ids):
            continue
        low, high = file.bounds(v, everything)
        own = file.own(label)
        high[own] = -(1 << 62)  # meets no window
        for positive, score, a, b in windows:
            meets = (high >= a) & (low <= b)
            certain = low[meets & (low >= a) & (high <= b)]
            for row, s in file.best(v, np.flatnonzero(meets & (high >= _kth(certain, k))), k, a, b):
                yield anchor, positive, score, row, s


def _blocks(anchors: DataFrame, n: int, shards: int, dim: int) -> DataFrame:
    """Anchors (vec_id, label, v, found) in packed blocks of at most about BLOCK, one copy of each for every shard."""
    count = max(1, -(-n // BLOCK))
    keyed = anchors.withColumn("blk", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(count)))
    packed = keyed.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "v", "found"))).alias("anchors"))
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("blk").cast("long").alias("vec_id"), F.lit(1).alias("kind"), "anchors")


_FOUND = "array<struct<vec_id:long,score:long>>"
_ANCHORS = f"array<struct<vec_id:long,label:long,v:array<long>,found:{_FOUND}>>"


def _visit(dealt: DataFrame, anchors: DataFrame, n_anchors: int, shards: int, dim: int, search, names: list[str]) -> DataFrame:
    """Every anchor block at every shard: ``search(file, ids, labels, vectors, found)`` gives rows of longs."""
    rows = dealt.select("shard", "vec_id", F.lit(0).alias("kind"), F.lit(None).cast(_ANCHORS).alias("anchors"), "label", "v")
    blocks = _blocks(anchors, n_anchors, shards, dim).select("shard", "vec_id", "kind", "anchors", F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("v"))
    met = rows.unionByName(blocks).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, file = None, [], None
        for batch in batches:
            number, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (np.diff(number) != 0) | (np.diff(kind) != 0)))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if number[lo] != shard:
                    shard, held, file = number[lo], [], None
                if kind[lo] == 0:
                    held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), dim)))
                    continue
                if file is None and held:
                    file = File(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if file is None:
                    continue
                for i in range(part.num_rows):
                    block = part.column("anchors")[i].values
                    ids, labels, found = block.field("vec_id").to_pylist(), block.field("label").to_pylist(), block.field("found").to_pylist()
                    out = list(search(file, ids, labels, _matrix(block.field("v"), dim), found))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
        tidy()

    return met.mapInArrow(work, ", ".join(f"{x} long" for x in names))


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; anchor: which rows are anchors, a condition on vec_id; a pair's negatives
    score between ``low`` and ``high`` hundredths of its positive.
    """
    rows, dim = usable(vectors, F.col("label") if label is None else label)
    rows = cut(rows)
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(anchor, 1))).first()
    shards = max(1, -(-n // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    chosen = rows.where(anchor)
    bare = chosen.withColumn("found", F.lit(None).cast(_FOUND))
    near = _visit(dealt, bare, n_anchors, shards, dim, lambda f, i, c, v, _: positives(f, i, c, v, n_positives), ["anchor_id", "vec_id", "score"])
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= n_positives)
    found = ranked.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    paired = cut(chosen.join(found, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "found"))
    hard = _visit(dealt, paired, n_anchors, shards, dim, lambda f, i, c, v, p: negatives(f, i, c, v, p, n_negatives, (low, high)), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
