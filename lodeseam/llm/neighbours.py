"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan.

1. A bounded sample (``SAMPLE_BYTES``) is clustered into lists on the driver; the
   number of lists to probe is the least that gives ``TARGET`` recall of exact
   neighbours within the sample.  A sample is farther apart than the whole
   table, so that this errs towards more probes.
2. Every vector is rotated by one random orthogonal matrix and assigned to a
   list.  Large lists are dealt into several units, and the queries that probe a list
   into blocks, so that no unit grows with the table; a vector goes only to the
   blocks of its own list.
3. A query probes as many lists, and more if these hold too few vectors for k.
   The sample only sets a floor: the score of its (k + ``SPARE``)-th best among the
   probed lists' members, which the scan is to find again.
4. In each probed unit, rotated vectors are scanned in blocks of columns.  After
   each block a hypothesis test abandons a candidate: with u dimensions seen, the
   rest of the product has a standard deviation of |q_rest| |x_rest| / sqrt(D - u)
   under a random rotation, and if the partial product plus ``Z`` of these stays
   below the floor, it can't be a neighbour but by rare chance; of a candidate along the
   query, whose rest has its cosine too, that much more is allowed (``_rest``).  Survivors are
   scored exactly, in double precision, on the original vectors.
5. What reaches the floor, few rows per query, is ranked.

Equal vectors: of each, only the k + 1 smallest ids can be among k neighbours, so
others are not searched (as queries they are).  Results are ranked by score, ties
by smaller vec_id.

Odd input: vectors that are null, zero, hold null or non-finite components, or are
not of the commonest length take no part, nor do null ids; of rows that repeat a
vec_id the smallest vector counts; fewer than k candidates are all returned; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, width

K, TARGET, Z = 20, 0.97, 3.5
SAMPLE_BYTES, UNIT, COLUMNS = 8 << 20, 2048, 16
#: How many more than k are to reach the floor, as the scan may abandon one by chance.
SPARE = 4
MOST_LISTS = 8192


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(column.flatten().buffers()[1], np.float64)[column.flatten().offset :][: len(column) * dim].reshape(-1, dim) if len(column) else np.zeros((0, dim))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors that take part, and their length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0].n if sizes else 1
    return rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


class Index:
    """Rotation, list centres and probe count, all from the sample."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, n_rows: int, k: int, seed: int = 11) -> None:
        n, dim = sample.shape
        draw = np.random.default_rng(seed)
        self.k, self.dim, self.ids, self.sample = k, dim, ids, sample
        self.rotation = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        lists = int(min(max(1, n // 16), MOST_LISTS, max(1, round(n_rows**0.5 / 2))))
        centres = sample[draw.choice(n, lists, False)].copy() if n else np.zeros((1, dim))
        for _ in range(8 if n else 0):
            own = self._nearest(sample, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, sample)
            sizes = np.bincount(own, minlength=lists)
            centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        self.centres = centres
        self.probes = self._tune(draw) if n > 1 else 1
        self.own = self.assign(sample)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = 0.5 * (centres * centres).sum(1)
        return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def probe_order(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), 1, kind="stable")

    def _tune(self, draw) -> int:
        pick = draw.choice(len(self.sample), min(256, len(self.sample)), False)
        scores = self.sample[pick] @ self.sample.T
        scores[np.arange(len(pick)), pick] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        best = np.argpartition(-scores, k - 1, 1)[:, :k]
        order = self.probe_order(self.sample[pick])
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
        need = np.sort(np.take_along_axis(rank, self.assign(self.sample)[best], 1).ravel())
        return int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1

    def probed(self, q: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(queries, lists): whether a query probes a list; sizes: vectors in each list."""
        order = self.probe_order(q)
        before = np.cumsum(sizes[order], 1) - sizes[order]
        out = np.zeros(order.shape, bool)
        # k and the query itself
        np.put_along_axis(out, order, (np.arange(order.shape[1]) < self.probes) | (before < self.k + 1), 1)
        return out

    def floors(self, ids: np.ndarray, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Score of each query's (k + SPARE)-th best of the sample within its lists, its own row left out; -inf if there are fewer."""
        out, k = [np.zeros(0)], self.k + SPARE
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            if len(self.ids) < k:
                out.append(np.full(len(part), -np.inf))
                continue
            s = part @ self.sample.T
            s[(ids[a : a + 256, None] == self.ids[None]) | ~probed[a : a + 256][:, self.own]] = -np.inf
            out.append(-np.partition(-s, k - 1, 1)[:, k - 1])
        return np.concatenate(out)


def _suffix_norms(rotated: np.ndarray, columns: int) -> np.ndarray:
    """|x_rest| after each block of columns."""
    squares = np.add.reduceat(rotated * rotated, np.arange(0, rotated.shape[1], columns), 1)
    return np.sqrt(np.maximum(0, squares[:, ::-1].cumsum(1)[:, ::-1] - squares))


def _rest(floor: np.ndarray, norms: np.ndarray, left: int, z: float) -> np.ndarray:
    """Greatest cosine of what remains of a neighbour at the floor: about its whole cosine and ``z`` - 1.5 deviations, ``z`` around 0 at least, 1 at most."""
    c = np.clip(np.where(norms > 0, floor / np.where(norms > 0, norms, 1), 0), 0, 1)
    return np.minimum(1, np.maximum(z / np.sqrt(max(1, left)), c + (z - 1.5) * np.sqrt((1 - c * c) / max(1, left))))


def scan(q: np.ndarray, floor: np.ndarray, x: np.ndarray, rotation: np.ndarray, columns: int = COLUMNS, z: float = Z) -> tuple[np.ndarray, np.ndarray, float]:
    """(query, candidate) index pairs that no test abandoned, and the share of multiplications done."""
    dim = x.shape[1]
    rq, rx = q @ rotation, x @ rotation
    nq, nx = _suffix_norms(rq, columns), _suffix_norms(rx, columns)
    seen = min(columns, dim)
    partial = rq[:, :seen] @ rx[:, :seen].T
    done = float(partial.size * seen)
    slack = np.abs(floor) * 1e-9 + 1e-12
    whole = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    bound = nq[:, :1] * nx[:, 0][None] * _rest(floor[:, None], whole, dim - seen, z)
    i, j = np.nonzero(partial + bound >= (floor - slack)[:, None])
    p = partial[i, j]
    for b in range(1, nq.shape[1]):
        lo, hi = b * columns, min(dim, (b + 1) * columns)
        p = p + np.einsum("pd,pd->p", rq[i, lo:hi], rx[j, lo:hi])
        done += len(p) * (hi - lo)
        keep = p + nq[i, b] * nx[j, b] * _rest(floor[i], whole[i, j], dim - hi, z) >= floor[i] - slack[i]
        i, j, p = i[keep], j[keep], p[keep]
    return i, j, done / max(1, partial.size * dim)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; queries (vec_id, embedding): by default the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    rows = cut(rows)
    n = rows.count()
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_BYTES // (8 * dim))).toArrow()
    index = Index(sampled.column("vec_id").to_numpy(), _matrix(sampled.column("v"), dim), n, k)
    sent = spark.sparkContext.broadcast(index)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0) if queries is None else usable(queries)[0].where(F.size("v") == dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(sent.value.assign(_matrix(b.column("v"), dim)), pa.int32())], ["vec_id", "v", "list"])

    among_equals = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    searched = rows.withColumn("copy", among_equals).where(F.col("copy") <= k + 1).select("vec_id", "v")
    assigned = cut(searched.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in assigned.groupBy("list").count().collect():  # one row per list, MOST_LISTS at most
        sizes[r["list"]] = r["count"]

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                q, ids = _matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
                probed = sent.value.probed(q, sizes)
                floor = sent.value.floors(ids, q, probed)
                lists = [np.flatnonzero(p).astype(np.int32) for p in probed]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(floor), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "floor", "lists"])

    aimed = cut(asked.mapInArrow(aim, "vec_id long, v array<double>, floor double, lists array<int>"))
    # a list's vectors are dealt into units, and the queries that probe it into blocks; each unit meets each block of its own list, and lists that none probes go nowhere
    asking = np.zeros(len(sizes), np.int64)
    for r in aimed.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        asking[r["list"]] = r["count"]
    grid = [(i, -(-int(n) // UNIT), -(-int(q) // UNIT)) for i, (n, q) in enumerate(zip(sizes, asking, strict=True)) if n and q]
    grid = F.broadcast(spark.createDataFrame(grid, "l int, units int, blocks int"))
    base = assigned.join(grid, F.col("list") == F.col("l")).select("list", F.pmod(F.xxhash64("vec_id"), "units").cast("int").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    probes = aimed.select("vec_id", "v", "floor", F.explode("lists").alias("list")).join(grid, F.col("list") == F.col("l"))
    probes = probes.select("list", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v", "floor")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        q, x = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
        qid, xid, floor = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), left.column("floor").to_numpy()
        out = []
        for a in range(0, len(q), 256):
            i, j, _ = scan(q[a : a + 256], floor[a : a + 256], x, sent.value.rotation)
            i = i + a
            other = qid[i] != xid[j]
            i, j = i[other], j[other]
            score = np.einsum("pd,pd->p", q[i], x[j])
            good = score >= floor[i] - np.abs(floor[i]) * 1e-12
            i, j, score = i[good], j[good], score[good]
            # no more than k of each query from one unit
            order = np.lexsort((xid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            first = place < k
            out.append(pa.table([qid[i[first]], xid[j[first]], score[first]], schema=_FOUND))
        return pa.concat_tables(out)

    keys = ("list", "unit", "block")
    n_parts = width(spark)
    found = probes.repartition(n_parts, *keys).groupBy(*keys).cogroup(base.repartition(n_parts, *keys).groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
