"""Periodic runs of words, by the suffix tree's branching tandem repeats (Stoye and Gusfield).

A run is a stretch of words with smallest period q, at least ``least`` words and
``ratio * q`` words long, that no neighbouring word extends keeping the period.

1. A run holds each of its words at least ``ratio`` times.  Words that are rarer in
   their text belong to no run and cut it into segments; so do words that are rare
   in their segment, until nothing changes.  Segments below ``least`` words go.
2. The segments of a batch form one forest of suffix trees, kept as suffix order and
   common prefixes: an inner node is an interval of the order, its depth the prefix.
3. At a node of depth D the leaf lists of all children but the largest are
   walked.  A leaf i with i + D (or i - D) in the node's interval starts (ends) a
   square of period D, and the square branches if the word behind it breaks the
   period.  Each leaf is in a smaller half at most log2(n) times.
4. A run ends with exactly one branching square of its smallest period.  The square is
   rotated to the left while the period holds; squares of a multiple of the period end
   at the same word and merge into the run.

All of it is one pass over the documents without a shuffle, so that no source or group
of copies can be hot; a text is worked on whole, in a batch of about 2 MB.

Odd input: a null or blank text has no words, no runs and an empty result; null
doc_ids stay; rows that repeat a doc_id are each handled; a very long text is one
batch; an empty table gives no rows; other columns are not looked at.  Words are
compared as 64-bit identities.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, NOT_SPACE, Words, binary_parts, mix, ranges, slices, table

#: A run's least length in words and in periods.
LEAST, RATIO = 24, 3
#: Leaves looked at together, and words compared together.
_CHUNK = 1 << 20
_U = np.uint64


def segments(ids: np.ndarray, first: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, tokens, edges): the words that may lie in runs, numbered within their segment, and where segments begin and end."""
    place, group = np.arange(len(ids)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    while True:
        _, token, count = np.unique(mix(ids[place] + group.astype(np.uint64) * _U(_BASE)), return_inverse=True, return_counts=True)
        often = count[token] >= ratio
        kept, owner = place[often], group[often]
        edge = np.flatnonzero(np.append(True, (np.diff(kept) != 1) | (np.diff(owner) != 0))) if len(kept) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(edge, len(kept)))
        long = np.repeat(sizes >= least, sizes)
        if long.all() and often.all():
            return place, token, np.append(edge, len(kept))
        place, group = kept[long], np.repeat(np.arange(len(edge)), sizes)[long]


def suffix_order(token: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes in order by doubling, and how many words each shares with the one before it.

    A suffix reaches to the end of its segment; tokens of different segments differ.
    """
    n = len(token)
    order = np.argsort(token, kind="stable")
    start = np.append(True, token[order[1:]] != token[order[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(start)[np.cumsum(start) - 1]
    levels, k = [rank.astype(np.int32)], 1
    while not start.all():
        shared = ~start
        shared[:-1] |= ~start[1:]
        at = np.flatnonzero(shared)
        a = order[at]
        second = np.where(a + k < end[a], rank[np.minimum(a + k, n - 1)] + 1, 0)
        inner = np.lexsort((second, rank[a]))
        a, second = a[inner], second[inner]
        new = np.append(True, (rank[a[1:]] != rank[a[:-1]]) | (second[1:] != second[:-1]))
        order[at], start[at] = a, new
        rank = rank.copy()
        rank[a] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank.astype(np.int32))
        k *= 2
    common = np.zeros(n, np.int64)
    pair = np.arange(1, n)
    x, y = order[:-1].copy(), order[1:].copy()
    ends = end[order]
    for j in range(len(levels) - 1, -1, -1):
        level = levels[j]
        same = (x < ends[:-1]) & (y < ends[1:])
        same &= level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]
        step = same.astype(np.int64) << j
        common[pair] += step
        x += step
        y += step
    return order, common


class _Least:
    """How far values on one side of a place stay large: minima over runs of 2**j values."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= self.n:
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The nearest earlier place with a value below the bound (-1: none)."""
        at = at.copy()
        for j in range(len(self.rows) - 1, -1, -1):
            to = at - (1 << j)
            at = np.where((to >= 0) & (self.rows[j][np.maximum(to, 0)] >= bound), to, at) if len(at) else at
        return at - 1

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The nearest later place with a value below the bound (n: none)."""
        at = at + 1
        for j in range(len(self.rows) - 1, -1, -1):
            fits = at + (1 << j) <= self.n
            at = at + ((fits & (self.rows[j][np.minimum(at, self.n - (1 << j))] >= bound)).astype(np.int64) << j)
        return at


def smaller_children(common: np.ndarray, deepest: int) -> tuple[np.ndarray, ...]:
    """(node low, node high, depth, child low, child high; inclusive) of every child but the largest of each inner node."""
    least = _Least(common)
    k = np.flatnonzero((common > 0) & (common <= deepest))
    depth = common[k]
    low, high, left = least.before(k, depth), least.after(k, depth), least.before(k, depth + 1)
    _, node, count = np.unique(low * (len(common) + 1) + high, return_inverse=True, return_counts=True)
    last = np.zeros(len(count), np.int64)
    np.maximum.at(last, node, np.arange(len(k)))
    node, low, high, depth = (np.concatenate([x, x[last]]) for x in (node, low, high, depth))
    begin, stop = np.concatenate([left, k[last]]), np.concatenate([k, high[len(k) :]])
    by_size = np.lexsort((stop - begin, node))
    largest = by_size[np.append(np.flatnonzero(np.diff(node[by_size])), len(by_size) - 1)] if len(by_size) else by_size
    small = np.ones(len(node), bool)
    small[largest] = False
    return tuple(x[small] for x in (low, high - 1, depth, begin, stop - 1))


def branching_squares(token: np.ndarray, begin: np.ndarray, end: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all squares whose period the next word breaks, periods up to ``deepest``."""
    order, common = suffix_order(token, end)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    padded = np.append(token, -1)
    low, high, depth, first, last = smaller_children(common, deepest)
    sizes = last - first + 1
    parts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()), _CHUNK), "right")
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(parts, np.append(parts[1:], len(sizes)), strict=True):
        leaf = order[ranges(first[a:b], sizes[a:b])]
        lo, hi, d = (np.repeat(x[a:b], sizes[a:b]) for x in (low, high, depth))
        for ahead in (True, False):
            other = leaf + d if ahead else leaf - d
            fits = other < end[leaf] if ahead else other >= begin[leaf]
            i, j, q, x, y = (v[fits] for v in (leaf, other, d, lo, hi))
            same = (place[j] >= x) & (place[j] <= y)
            one, two, q = np.minimum(i, j)[same], np.maximum(i, j)[same], q[same]
            stop = two + q
            breaks = (stop >= end[one]) | (padded[np.minimum(stop, len(token))] != padded[two])
            starts.append(one[breaks])
            periods.append(q[breaks])
    keys = np.unique(np.concatenate(starts) * (len(token) + 1) + np.concatenate(periods))
    return keys // (len(token) + 1), keys % (len(token) + 1)


def rotations(token: np.ndarray, start: np.ndarray, period: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many words each square can be rotated to the left within its segment."""
    done, live, block = np.zeros(len(start), np.int64), np.arange(len(start)), 16
    while len(live):
        still = []
        for rows in np.array_split(live, max(1, len(live) * block // _CHUNK)):
            back = start[rows, None] - done[rows, None] - 1 - np.arange(block)
            inside = back >= begin[start[rows], None]
            back = np.maximum(back, 0)
            same = inside & (token[back] == token[back + period[rows, None]])
            whole = same.all(1)
            done[rows] += np.where(whole, block, np.argmin(same, 1))
            still.append(rows[whole])
        live, block = np.concatenate(still), min(2 * block, 1 << 14)
    return done


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, ratio: int = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; text i holds the words first[i] to first[i + 1]."""
    if ratio < 2:
        raise ValueError("a run repeats its period at least twice")
    place, token, edges = segments(ids, first, least, ratio)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    sizes = np.diff(edges)
    begin, end = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
    start, period = branching_squares(token, begin, end, int(sizes.max()) // ratio)
    found = []
    by_end = np.lexsort((period, start + 2 * period))
    start, period = start[by_end], period[by_end]
    while len(start):
        stop = start + 2 * period
        head = np.append(True, stop[1:] != stop[:-1])
        s, q = start[head], period[head]
        length = 2 * q + rotations(token, s, q, begin)
        fine = length >= np.maximum(least, ratio * q)
        found.append((s[fine] + 2 * q[fine] - length[fine], length[fine], q[fine]))
        # squares of a multiple of the period, within the run, are the run itself
        own = np.cumsum(head) - 1
        rest = ~head & ~((period % q[own] == 0) & (2 * period <= length[own]))
        start, period = start[rest], period[rest]
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
    by_start = np.lexsort((period, start))
    return place[start[by_start]] if len(start) else none, length[by_start], period[by_start]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words left, joined by single spaces.

    A word goes if any run contains it after that run's first period.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), NOT_SPACE)
                start, length, period = find_runs(words.ids(), words.first, least, ratio)
                edge = np.bincount(start + period, minlength=len(words.start) + 1) - np.bincount(start + length, minlength=len(words.start) + 1)
                kept = np.cumsum(edge[:-1]) == 0
                shorter = np.add.reduceat(np.append(~kept, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
                at = np.searchsorted(start, words.first)
                inside = pa.StructArray.from_arrays([pa.array(start - np.repeat(words.first[:-1], np.diff(at))), pa.array(length), pa.array(period)], ["start", "length", "period"])
                raw, offsets = binary_parts(batch.column("text"))
                texts = []
                for i in range(batch.num_rows):
                    own = raw[offsets[i] : offsets[i + 1]].tobytes().split()
                    texts.append(b" ".join(compress(own, kept[words.first[i] : words.first[i + 1]].tolist()) if shorter[i] else own))
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), inside)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which every tenth document (by its checksum h) repeats a stretch of its words to its end; others unchanged."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))))

    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    bound = F.transform(F.array(words), repeated)[0]  # so that the words are split once
    return F.when(h % 10 == 0, bound).otherwise(text)


def digests(collapsed: DataFrame) -> DataFrame:
    """One row per document: its runs in figures and digests."""
    better = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"])  # noqa: E731 - runs come by start and period: ties keep the first
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"), milli, "runs_sha256", "collapsed_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(collapse_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
