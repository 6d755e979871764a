"""Exact nearest rows of many queries: blocks of queries visit every shard of rows.

Rows are dealt by their id into shards of about ``SHARD``, queries into blocks of about ``BLOCK``, and each
block visits every shard.  A visit bounds all its squared distances by one matrix product; what may be
among a query's k nearest by that bound and its rounding error is measured exactly, component after
component, and k rows a query leave the shard.  A task holds one shard and one block, whatever the
table's size; what is sent are the rows once, the queries once a shard and k rows a query and shard.
The search is exact, so that its work grows with rows times queries.

Odd input: components that are null on either side, or beyond the shorter vector's end, are left
out of a distance; without any the distance is null, and comes last; NaN comes before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 16384, 512
#: Queries whose bounds are held at once.
_AT_ONCE = 64


class Vectors:
    """Vectors padded to one width; gone: components that are null or padding; odd: rows that a product can't bound."""

    def __init__(self, column: pa.Array) -> None:
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().cast(pa.float64())
        n, self.width = len(column), int(size.max(initial=0))
        inside = np.arange(self.width) < size[:, None]
        self.values, self.gone = np.zeros((n, self.width)), ~inside
        self.values[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.gone[inside] = flat.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            self.squares = np.einsum("ij,ij->i", self.values, self.values)
            self.odd = self.gone.any(1) | ~(self.squares < 1e300)
        self.any_gone = bool(self.gone.any())

    def distances(self, rows: np.ndarray, other: Vectors, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances of rows from the i-th of ``other``, which are null), added up in the order of components."""
        width = min(self.width, other.width)
        total, seen = np.zeros(len(rows)), np.zeros(len(rows), bool)
        part, q, gone = self.values[rows, :width], other.values[i], other.gone[i]
        lost = self.gone[rows, :width] if self.any_gone else None
        with np.errstate(over="ignore", invalid="ignore"):
            for c in np.flatnonzero(~gone[:width]):
                d = part[:, c] - q[c]
                d *= d
                if lost is None:
                    total += d
                else:
                    total += np.where(lost[:, c], 0.0, d)
                    seen |= ~lost[:, c]
        return total, ~seen if lost is not None else np.full(len(rows), gone[:width].all())


class Shard:
    def __init__(self, ids: np.ndarray, labels: pa.Array, column: pa.Array) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels.take(pa.array(order)), Vectors(column.take(pa.array(order)))
        v = self.vectors
        self.plain = np.where(v.odd[:, None], 0.0, v.values)
        self.squares = np.where(v.odd, np.inf, v.squares)
        self.most = float(v.squares[~v.odd].max(initial=0.0))
        self.measured = 0

    def nearest(self, ids: np.ndarray, queries: Vectors, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, rows, distances, which are null): each query's k nearest other rows, nearest first."""
        alike = queries.width == self.vectors.width
        for lo in range(0, len(ids), _AT_ONCE):
            hi = min(len(ids), lo + _AT_ONCE)
            if alike:
                q = np.where(queries.odd[lo:hi, None], 0.0, queries.values[lo:hi])
                bound = self.squares - 2.0 * (q @ self.plain.T)
            for i in range(lo, hi):
                own = slice(*np.searchsorted(self.ids, [ids[i], ids[i] + 1]).tolist())
                if alike and not queries.odd[i] and len(self.ids) > k:
                    b = bound[i - lo]
                    b[own] = np.inf
                    # a product and a sum of squares each stray by less than this from the distance
                    stray = 8 * (queries.width + 8) * 2.0**-53 * (float(queries.squares[i]) + self.most)
                    near = (b <= np.partition(b, k - 1)[k - 1] + 2 * stray) | self.vectors.odd
                else:
                    near = np.ones(len(self.ids), bool)
                near[own] = False
                rows = np.flatnonzero(near)
                d, null = self.vectors.distances(rows, queries, i)
                self.measured += len(rows)
                d[null] = 0.0
                best = np.lexsort((self.ids[rows], d, null))[:k]
                yield i, rows[best], d[best], null[best]


_QUERIES = "array<struct<query:long,ql:long,qv:array<double>>>"


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query, ql, vec_id, label, d, rank: the k rows of least squared distance d from each query, ties by vec_id, its own id excepted.

    rows: vec_id, embedding, label; ql is the query's label.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    n, m = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    queries = rows.where(is_query).groupBy(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("query"), F.col("label").alias("ql"), F.col("embedding").alias("qv"))).alias("qs"))
    visits = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("block").cast("long").alias("vec_id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<double>").alias("embedding"), "qs")
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "label", "embedding", F.lit(None).cast(_QUERIES).alias("qs"))
    met = dealt.unionByName(visits).repartition(shards, "shard").sortWithinPartitions("shard", F.col("qs").isNotNull(), "vec_id")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("qs").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (np.diff(numbers) != 0) | (np.diff(asks) != 0))).tolist() if batch.num_rows else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != number:
                    number, held, shard = numbers[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if shard is None and held:
                    whole = pa.Table.from_batches(held)
                    shard = Shard(whole["vec_id"].to_numpy(), whole["label"].combine_chunks(), whole["embedding"].combine_chunks())
                    held = []
                if shard is None:
                    continue
                for r in range(part.num_rows):
                    block = part.column("qs")[r].values
                    ids, labels = block.field("query").to_numpy(), block.field("ql")
                    found = list(shard.nearest(ids, Vectors(block.field("qv")), k))
                    of = np.repeat([i for i, *_ in found], [len(x) for _, x, *_ in found]).astype(np.int64)
                    at, d, null = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), labels.take(pa.array(of)), pa.array(shard.ids[at]), shard.labels.take(pa.array(at)), pa.array(d, mask=null)], ["query", "ql", "vec_id", "label", "d"])

    found = met.mapInArrow(visit, "query long, ql long, vec_id long, label long, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("d"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
