"""Exact nearest neighbours without a full scan: pivots and the triangle inequality.

Every row keeps its nearest pivot and the distance to it; the table is written in
that order, so that a row group covers few pivots and a narrow range of distances.  For a query at
distance d from a pivot, a row at distance x from the same pivot is at least |d - x| away.
A first look at the query's nearest pivots gives a k-th best distance; then only row
groups and rows are read whose bound doesn't exceed it, by filters that reach the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from . import retrieval as R

#: Pivots, and how many of them the first look takes.
PIVOTS, FIRST = 32, 2


def choose(rows: DataFrame, keys: list[str], vector: str, n: int = PIVOTS) -> list[list[float]]:
    """n rows' vectors, drawn by a hash of the keys: n times the dimension is all that the driver holds."""
    drawn = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(*keys).alias("h"), *keys, F.col(vector).cast("array<double>").alias("v")).orderBy("h", *keys).limit(n).collect()
    return [list(r.v) for r in drawn]


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def pivot_table(rows: DataFrame, keys: list[str], vector: str, pivots: list[list[float]]) -> DataFrame:
    """``rows`` with a vector, with pivot (its number) and away (the distance to it), written in their order."""
    known = F.array(*(F.struct(F.array(*map(F.lit, p)).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(pivots))).cast("array<struct<p:array<double>,i:int>>")
    near = F.array_min(F.transform(known, lambda c: F.struct(_distance(F.col(vector), c["p"]).alias("away"), c["i"].alias("pivot"))))
    dealt = rows.where(F.col(vector).isNotNull()).withColumn("_n", near).select(*rows.columns, F.col("_n.pivot").alias("pivot"), F.col("_n.away").alias("away"))
    return written(dealt.repartitionByRange("pivot", "away").sortWithinPartitions("pivot", "away"), "pivots")


def within(query: list[float], pivots: list[list[float]], distance: float) -> Column:
    """Rows of a pivot table that may lie within the distance."""
    rim = distance * (1 + 1e-9) + 1e-9  # distances are rounded
    parts = []
    for i, p in enumerate(pivots):
        d = math.dist(query, p)
        parts.append((F.col("pivot") == i) & (F.col("away") >= d - rim) & (F.col("away") <= d + rim))
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def nearest(table: DataFrame, keys: list[str], vector: str, pivots: list[list[float]], query: list[float], k: int) -> DataFrame:
    """keys, distance of the k nearest rows, ties by key: those of a full scan."""
    query = [float(x) for x in query]
    if not pivots:
        return table.select(*keys, F.lit(0.0).alias("distance")).limit(0)
    found = lambda rows: rows.select(*keys, R.distance(F.col(vector), query).alias("distance")).orderBy("distance", *keys).limit(k)
    return found(table.where(reach(table, keys, vector, pivots, query, k)))


def reach(table: DataFrame, keys: list[str], vector: str, pivots: list[list[float]], query: list[float], k: int) -> Column:
    """The condition for rows to read: within the k-th distance of a first look, or true where that finds fewer than k."""
    by = sorted(range(len(pivots)), key=lambda i: math.dist(query, pivots[i]))[:FIRST]
    first = table.where(F.col("pivot").isin(by)).select(R.distance(F.col(vector), query).alias("d")).orderBy("d").limit(k).agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
    return within(query, pivots, first.d) if first.n == k and k else F.lit(True)


def semantic_top(table: DataFrame, keys: list[str], vector: str, pivots: list[list[float]], query: list[float], k: int) -> DataFrame:
    """keys, score = exp(-distance) of the k best rows."""
    return nearest(table, keys, vector, pivots, query, k).select(*keys, F.exp(-F.col("distance")).alias("score"))
