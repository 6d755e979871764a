"""Connected components of an undirected graph: contraction in pieces, then large and small stars.

Edges are first contracted piece by piece: a task joins the ends of up to ``PIECE``
edges and replaces them by stars, one edge per node.  Where one piece holds all
edges, these stars are the components.  Otherwise every round rewires each node's
larger neighbours, then its smaller ones, to the least neighbour; after about
log2(size) rounds every component is a star around its least node.  Minima are
aggregated before the shuffle and joined back, so that a node with very many edges
is never gathered in one task: Spark may split the join.  Rounds are cut from their
lineage in the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts at once: 16 bytes each.
PIECE = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())


def joined_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each one's component, where ``root`` has those of the components before edges (x, y)."""
    while len(x):
        # each tree's root goes below the least root across an edge, then all paths are shortened
        one, two = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = one != two
        x, y = x[apart], y[apart]
        np.minimum.at(root, two[apart], one[apart])
        while (root != (higher := root[root])).any():
            root = higher
    return root


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of the edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = joined_roots(np.arange(len(nodes)), x, y)
    return nodes, nodes[root]


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """Edges (a > b) in pieces, each replaced by the stars of its components."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            node, root = contracted(*(np.concatenate(c) for c in zip(*held, strict=True)))
            other = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) >= PIECE:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.coalesce(max(1, -(-n // PIECE))).mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b; longs) and the least node of its component.

    Self-loops and repeated edges do no harm; rows with a null end are ignored.
    """
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))  # computed once, used twice below
    alone = edges.where("a = b").select("a").distinct()
    n = edges.count()
    # the greatest number of edges in a batch is far below PIECE, so that n <= PIECE is one piece
    edges = cut(_stars(edges.where("a <> b"), n))
    before = _state(edges) if n > PIECE else (0, 0)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        ends = large.join(least, F.col("a") == F.col("u"))
        small = ends.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    rest = alone.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(roots).unionByName(rest.join(stars.unionByName(roots), "node", "left_anti"))
