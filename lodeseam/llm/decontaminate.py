"""Benchmark decontamination: a prefix-filtered join of item windows and documents.

Every item becomes windows of ``size`` consecutive words (a shorter item is one
window).  A window is a set of shingles of three words (of fewer, if it is
shorter), and a document contains it only if it contains every shingle; so the
necessary prefix for full containment is one shingle, and the best is the one
that fewest documents hold.

1. One pass counts, for the shingles of the items, the documents that contain
   them, added up per task and then by shingle.
2. Each window is indexed under its rarest shingle and the offset of it.
3. One pass over the documents finds the indexed shingles (a bit table of fixed
   size, then a search), derives where the window would start, drops starts
   that leave the document (positional and length bounds), and compares the
   rest word by word.

The index is broadcast in blocks of at most ``block_rows`` windows, measured
before; a document passes all blocks in turn, each adding its hits to the row.
Documents are never shuffled, so that no source or passage can be hot.

Odd input: null text: no words; an item without words has no window; null
item_id is listed as the empty string; repeated items and rows count as they
stand (an item_id once per document); null doc_id stays null; a very long
document is searched whole; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, Words, ranges, slices, table, window_hash

SIZE, SHINGLE = 10, 3
#: Windows of an index block: with 8 bytes a word, about 50 MB at most.
BLOCK_ROWS = 1 << 18
_FILTER_BITS = 22
_U = np.uint64


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id (string), words (64-bit identities, packed) of each distinct window of each item."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"), ALNUM, lower=True)
                ids, names = w.ids(), batch.column("item_id").to_pylist()
                rows: dict[tuple, None] = {}
                for name, lo, hi in zip(names, w.first[:-1], w.first[1:], strict=True):
                    for at in range(lo, max(lo + 1, hi - size + 1)):
                        if at < hi:
                            rows[(name, ids[at : min(hi, at + size)].tobytes())] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "words"])

    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.mapInArrow(cut_up, "item_id string, words binary").distinct()


class _Filter:
    """Finds which of many hashes are among a sorted few."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(keys >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, indexes in keys) of the members."""
        at = np.flatnonzero(self.table[(hashes >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        right = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[right], k[right]


def _shingles(window: np.ndarray) -> np.ndarray:
    return window_hash(window, min(SHINGLE, len(window)), salt=min(SHINGLE, len(window)))


def _document_counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each shingle size: in how many documents each of its shingles occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: _Filter(k) for s, k in sent.value.items()}
        totals = {s: np.zeros(len(k), np.int64) for s, k in sent.value.items()}
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"), ALNUM, lower=True)
                ids = w.ids()
                for s, f in filters.items():
                    at, k = f.find(window_hash(ids, s, salt=s))
                    inside = w.doc[at] == w.doc[at + s - 1]
                    pairs = np.unique(w.doc[at[inside]].astype(np.int64) * len(f.keys) + k[inside])
                    totals[s] += np.bincount(pairs % max(1, len(f.keys)), minlength=len(f.keys))
        for s, t in totals.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s), pa.int32()), pa.array(some, pa.int32()), pa.array(t[some], pa.int64())], ["size", "k", "n"])

    found = docs.select("text").mapInArrow(count, "size int, k int, n long").groupBy("size", "k").agg(F.sum("n").alias("n")).toPandas()
    out = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
    for s in out:
        mine = found[found["size"] == s]
        out[s][mine["k"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
    return out


def _index(docs: DataFrame, windows: pa.Table) -> dict:
    """Index of a block of (item_id, words): for each shingle size and window length the prefix shingles, offsets and words."""
    texts = sorted(set(windows.column("words").to_pylist()))
    number = {t: i for i, t in enumerate(texts)}
    owner = np.array([number[t] for t in windows.column("words").to_pylist()], np.int64)
    names = np.array(windows.column("item_id").to_pylist(), object)
    order = np.argsort(owner, kind="stable")
    items, item_at = names[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    arrays = [np.frombuffer(t, np.uint64) for t in texts]
    hashes = [_shingles(a) for a in arrays]
    sizes = np.array([min(SHINGLE, len(a)) for a in arrays])
    keys = {int(s): np.unique(np.concatenate([h for h, z in zip(hashes, sizes, strict=True) if z == s])) for s in np.unique(sizes)}
    counts = _document_counts(docs, keys)
    lists: dict[tuple[int, int], list] = {}
    for n, (a, h, s) in enumerate(zip(arrays, hashes, sizes, strict=True)):
        rarity = counts[int(s)][np.searchsorted(keys[int(s)], h)]
        offset = int(np.lexsort((h, rarity))[0])
        lists.setdefault((int(s), len(a)), []).append((h[offset], offset, n))
    groups = {}
    for k, rows in lists.items():
        rows.sort()
        prefix = np.array([r[0] for r in rows], np.uint64)
        own = np.unique(prefix)
        groups[k] = {"keys": own, "at": np.searchsorted(prefix, np.append(own, 0)[:-1]), "count": np.diff(np.append(np.searchsorted(prefix, own), len(prefix))), "offset": np.array([r[1] for r in rows]), "window": np.array([r[2] for r in rows]), "words": np.stack([arrays[r[2]] for r in rows])}
    return {"groups": groups, "items": items, "item_at": item_at}


def _search(docs: DataFrame, index: dict) -> DataFrame:
    """Adds a block's hits to each row: spans (document word, length as int64 pairs) and items."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.schema
    own = [c for c in schema.names if c not in ("spans", "items")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, items, item_at = (sent.value[k] for k in ("groups", "items", "item_at"))
        filters = {k: _Filter(g["keys"]) for k, g in groups.items()}
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"), ALNUM, lower=True)
                ids = w.ids()
                first, docs_hit, starts, lengths, windows = w.first, [], [], [], []
                hashes = {s: window_hash(ids, s, salt=s) for s, _ in groups}
                for (s, length), g in groups.items():
                    at, k = filters[s, length].find(hashes[s])
                    for lo in range(0, len(at), 1 << 16):
                        p, q = at[lo : lo + (1 << 16)], k[lo : lo + (1 << 16)]
                        rows = ranges(g["at"][q], g["count"][q])
                        p = np.repeat(p, g["count"][q])
                        d, begin = w.doc[p], p - g["offset"][rows]
                        fits = (begin >= first[d]) & (begin + length <= first[d + 1])
                        begin, rows, d = begin[fits], rows[fits], d[fits]
                        for j in range(length):
                            same = ids[begin + j] == g["words"][rows, j]
                            begin, rows, d = begin[same], rows[same], d[same]
                        docs_hit.append(d)
                        starts.append(begin - first[d])
                        lengths.append(np.full(len(d), length, np.int64))
                        windows.append(g["window"][rows])
                d = np.concatenate(docs_hit) if docs_hit else np.zeros(0, np.int64)
                spans, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                if len(d):
                    order = np.argsort(d, kind="stable")
                    d, pairs, win = d[order], np.stack([np.concatenate(starts)[order], np.concatenate(lengths)[order]], 1).astype(np.int64), np.concatenate(windows)[order]
                    cuts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    for lo, hi in zip(cuts, np.append(cuts[1:], len(d)), strict=True):
                        r = int(d[lo])
                        spans[r] += pairs[lo:hi].tobytes()
                        seen = np.unique(win[lo:hi])
                        names[r] = sorted(set(names[r]).union(items[ranges(item_at[seen], item_at[seen + 1] - item_at[seen])]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.string()))], [*own, "spans", "items"])

    return docs.select(*own, "spans", "items").mapInArrow(scan, StructType([*(schema[c] for c in own), schema["spans"], schema["items"]]))


def find_items(docs: DataFrame, items: DataFrame, size: int = SIZE, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns ``keep`` (text among them), spans, items: which item windows occur in each document, and where."""
    docs = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in keep))
    windows = item_windows(items, size)
    blocks = max(1, -(-windows.count() // block_rows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)))
    found = docs.select(*keep, F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block, rows in sorted(tuple(r) for r in windows.groupBy("block").count().collect()):
        if rows > 2 * block_rows:  # hashing doesn't deal them out evenly, but never so badly
            raise RuntimeError("an index block holds more than twice the rows it was planned for")
        found = _search(found, _index(docs, windows.where(F.col("block") == block).drop("block").toArrow()))
    return found


_SUMMARY = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def summarise(found: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"), ALNUM, lower=True)
                spans, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                hit = np.zeros(batch.num_rows, np.int64)
                for i, s in enumerate(spans):
                    if s:
                        pairs = np.frombuffer(s, np.int64).reshape(-1, 2)
                        edge = np.bincount(pairs[:, 0], minlength=w.counts[i] + 1) - np.bincount(pairs.sum(1), minlength=w.counts[i] + 1)
                        hit[i] = (np.cumsum(edge) > 0).sum()
                sums = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(hit), pa.array([len(n) for n in names], pa.int64()), pa.array(sums, pa.string()), pa.array(hit > 0)], schema=_SUMMARY)

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TOKENS} AS ws FROM benchmark),
     iw AS (
  SELECT DISTINCT item_id, least(len(ws), {SIZE}) AS n, array_to_string(ws[i:i + least(len(ws), {SIZE}) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {SIZE - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
     dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
     hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
