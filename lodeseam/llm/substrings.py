"""Substring dedup: repeated word windows, found with a count-min prefilter.

A word is covered, and removed, if some window of ``size`` consecutive words
around it also starts in a document with a smaller doc_id.  All windows are
judged on the input.

Documents are dealt into blocks by doc_id (one shuffle of texts, which all
three passes share).  A block's windows are 128-bit hashes (A, B); the top bits
of A choose a shard of the hash space, so that neither a task nor the driver
ever holds a sketch of the whole corpus.

1. Sketch.  A block sends each shard the cells that its windows touch in the
   two rows of a count-min sketch, with a flag for those that two of its
   documents share; a shard adds the blocks' sketches (counts saturate at 2)
   and answers each block with one bit per sent cell: counted twice or more.
   Counts can only be too high, so a window that repeats is never lost.
2. Exact grouping.  Only windows whose both cells answered yes go to their
   shard, once per block, with 96 bits of hash and the block's smallest doc_id.
   The shard groups them exactly and tells each block which of its windows
   start in a smaller document of another block.
3. Removal.  A block marks the answered windows and those whose smaller
   document lies in the block itself, and cuts the words.

What is sent is about 2.5 bytes a window, and 15 bytes for each that seems to
repeat.  A block sends messages only to the shards that its windows touch, so that
there are never more messages than windows; while a block touches most shards (up
to some TB of text) a message holds many windows.  Windows are compared by 96 bits
of hash of 64-bit word identities (see ``common.Words.ids``), not by their bytes.
Everything is a function of the blocks' rows, so that lost tasks can be repeated.

Odd input: null text: no words, digest of the empty text; a null doc_id has no
order: such a row neither loses words nor takes them from others; rows that
share a doc_id are all returned and take nothing from each other; texts shorter
than a window lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, binary_parts, pack_sorted, table, text_bytes, tidy, unpack_sorted, width, window_hash

SIZE = 13
#: Text bytes that a block is planned for, windows that a shard is planned for, log2 of cells in a row of its sketch.
BLOCK_BYTES, SHARD_WINDOWS, CELL_BITS = 12 << 20, 1 << 22, 23

_U = np.uint64
_MSG = pa.schema([("blk", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
_MSG_DDL = "blk long, shard long, data binary"


class _Block:
    """The windows of a block, grouped by equal hash and in order of it."""

    def __init__(self, rows: pa.Table, size: int, shard_bits: int) -> None:
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
        null = np.asarray(rows.column("doc_id").is_null())
        ids = np.where(null, 0, ids).astype(np.int64)
        self.rows = rows
        self.words = w = Words(rows.column("text"), NOT_SPACE)
        word_ids = w.ids()
        a = window_hash(word_ids, size)
        b = window_hash(word_ids, size, salt=0x5851F42D4C957F2D)
        inside = np.flatnonzero((w.doc[: len(a)] == w.doc[size - 1 :][: len(a)]) & ~null[w.doc[: len(a)]]) if len(a) else np.zeros(0, np.int64)
        doc_ids, rank = np.unique(ids, return_inverse=True)
        self.doc_ids = doc_ids
        a = a[inside]
        order = np.argsort(a)
        a, inside = a[order], inside[order]
        b, doc = b[inside], rank[w.doc[inside]]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1])
        # windows that agree in A but not in B, a matter of chance, part company here
        if len(a) and (~new[1:] & (b[1:] != b[:-1])).any():
            order = np.lexsort((b, a))
            a, b, doc, inside = a[order], b[order], doc[order], inside[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.at = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.position, self.doc = inside, doc
        self.a, self.b = a[self.at], b[self.at]
        self.least = np.minimum.reduceat(doc, self.at) if len(a) else doc
        self.most = np.maximum.reduceat(doc, self.at) if len(a) else doc
        self.shard_bits = shard_bits
        self.shard = (self.a >> _U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(self.a), np.int64)
        #: cells of the two rows, with the shard above them
        bits = _U(CELL_BITS)
        self.rows_of_cells = (
            (self.a << _U(shard_bits)) >> _U(64 - CELL_BITS) | self.shard.astype(np.uint64) << bits,
            self.b >> _U(64 - CELL_BITS) | self.shard.astype(np.uint64) << bits,
        )

    def sent_cells(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each row of the sketch: the distinct cells in order, and which of them two documents of this block share."""
        out = []
        twice = self.least != self.most
        for cells in self.rows_of_cells:
            marked = np.sort(cells << _U(1) | (~twice).astype(np.uint64))  # a shared one comes first
            cell = marked >> _U(1)
            new = np.ones(len(cell), bool)
            new[1:] = cell[1:] != cell[:-1]
            at = np.flatnonzero(new)
            several = np.diff(np.append(at, len(cell))) > 1
            out.append((cell[at], several | (marked[at] & _U(1) == 0)))
        return out


def _by_shard(keys: np.ndarray, shards: np.ndarray) -> list[tuple[int, int]]:
    """Where the cells of each of the shards begin and end."""
    shards = shards.astype(np.uint64)
    return list(zip(np.searchsorted(keys, shards << _U(CELL_BITS)).tolist(), np.searchsorted(keys, (shards + _U(1)) << _U(CELL_BITS)).tolist(), strict=True))


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], _MSG.field(i).type) for i in range(3)], schema=_MSG)


def repeated_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept text of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(docs, "text")
    shuffle = width(spark)
    blocks = max(4 * shuffle, -(-total // BLOCK_BYTES))
    shard_bits = max(0, int(np.ceil(np.log2(max(1.0, total / 6 / SHARD_WINDOWS, shuffle)))))
    dealt = docs.withColumn("blk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks))).repartition(shuffle, "blk")

    def sketch(rows: pa.Table) -> pa.Table:
        block = _Block(rows, size, shard_bits)
        blk = rows.column("blk")[0].as_py()
        tidy()
        sent = block.sent_cells()
        touched = np.unique(block.shard)  # both rows of a window's cells lie in its shard
        out = []
        for s, *cuts in zip(touched.tolist(), *(_by_shard(cells, touched) for cells, _ in sent), strict=True):
            parts = []
            for (cells, twice), (lo, hi) in zip(sent, cuts, strict=True):
                parts += [pack_sorted(cells[lo:hi] & _U((1 << CELL_BITS) - 1)), np.packbits(twice[lo:hi]).tobytes()]
            out.append((blk, s, _join(parts)))
        return _messages(out)

    def merge(rows: pa.Table) -> pa.Table:
        counts = np.zeros((2, 1 << CELL_BITS), np.uint8)
        blks, data, shard = rows.column("blk").to_pylist(), rows.column("data"), rows.column("shard")[0].as_py()
        for x in data:
            parts = _split(x.as_py())
            for r in (0, 1):
                cells = unpack_sorted(parts[2 * r])
                twice = np.unpackbits(np.frombuffer(parts[2 * r + 1], np.uint8), count=len(cells))
                counts[r, cells] = np.minimum(counts[r, cells] + 1 + twice, 2)
        out = []
        for blk, x in zip(blks, data, strict=True):
            parts = _split(x.as_py())
            out.append((blk, shard, _join([np.packbits(counts[r, unpack_sorted(parts[2 * r])] > 1).tobytes() for r in (0, 1)])))
        return _messages(out)

    def candidates(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _messages([])
        block = _Block(rows, size, shard_bits)
        blk = rows.column("blk")[0].as_py()
        keep = np.ones(len(block.a), bool)
        given = dict(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True))
        for r, (cells, _) in enumerate(block.sent_cells()):
            hot = np.zeros(len(cells), bool)
            for data, (lo, hi) in zip(given.values(), _by_shard(cells, np.array(list(given))), strict=True):
                hot[lo:hi] = np.unpackbits(np.frombuffer(_split(data)[r], np.uint8), count=hi - lo)
            keep &= hot[np.searchsorted(cells, block.rows_of_cells[r])]
        chosen = np.flatnonzero(keep)
        a, b, least = block.a[chosen], (block.b[chosen] >> _U(32)).astype(np.uint32), block.least[chosen]
        touched, begin = np.unique(block.shard[chosen], return_index=True)
        out = []
        for s, lo, hi in zip(touched.tolist(), begin, np.append(begin[1:], len(chosen))[: len(begin)], strict=True):
            used, place = np.unique(least[lo:hi], return_inverse=True)
            out.append((blk, s, _join([pack_sorted(chosen[lo:hi]), a[lo:hi].tobytes(), b[lo:hi].tobytes(), pack_sorted(block.doc_ids[used]), place.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes()])))
        return _messages(out)

    def group(rows: pa.Table) -> pa.Table:
        parts = [_split(x.as_py()) for x in rows.column("data")]
        blks, shard = rows.column("blk").to_pylist(), rows.column("shard")[0].as_py()
        a = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
        b = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts])
        doc = np.empty(len(a), np.int64)
        ends = np.cumsum([len(p[1]) // 8 for p in parts])
        for p, end in zip(parts, ends, strict=True):
            n = len(p[1]) // 8
            doc[end - n : end] = unpack_sorted(p[3])[np.frombuffer(p[4], np.uint16 if len(p[4]) == 2 * n else np.uint32)]
        order = np.argsort(a)
        sa, sb = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = sa[1:] != sa[:-1]
        if (~new[1:] & (sb[1:] != sb[:-1])).any():
            order = np.lexsort((b, a))
            sa, sb = a[order], b[order]
            new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], at)
        lost = np.zeros(len(a), bool)
        lost[order] = least[np.cumsum(new) - 1] < doc[order]
        out = []
        for blk, p, end in zip(blks, parts, ends, strict=True):
            mine = lost[end - len(p[1]) // 8 : end]
            if mine.any():
                out.append((blk, shard, pack_sorted(unpack_sorted(p[0])[mine])))
        return _messages(out)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return result.empty_table()
        block = _Block(rows, size, shard_bits)
        gone = np.zeros(len(block.a), bool)
        for x in answers.column("data"):
            gone[unpack_sorted(x.as_py())] = True
        hit = block.position[gone[block.group] | (block.doc > block.least[block.group])]
        w = block.words
        # a covered word: more covering windows have begun than ended
        n = len(w.start) + 1
        edge = np.bincount(hit, minlength=n) - np.bincount(hit + size, minlength=n)
        covered = np.cumsum(edge[:-1]) > 0
        raw, offsets = binary_parts(rows.column("text"))
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), w.first[:-1]) * (w.counts > 0)
        sums, texts = [], []
        for i in range(rows.num_rows):
            words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
            if removed[i]:
                words = compress(words, (~covered[w.first[i] : w.first[i + 1]]).tolist())
            kept = b" ".join(words)
            sums.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        tidy()
        return pa.table([rows.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums), pa.array(texts)], schema=result)

    cells = dealt.groupBy("blk").applyInArrow(sketch, _MSG_DDL)
    hot = cells.groupBy("shard").applyInArrow(merge, _MSG_DDL)
    seen = dealt.groupBy("blk").cogroup(hot.repartition(shuffle, "blk").groupBy("blk")).applyInArrow(candidates, _MSG_DDL)
    lost = seen.groupBy("shard").applyInArrow(group, _MSG_DDL)
    return dealt.groupBy("blk").cogroup(lost.repartition(shuffle, "blk").groupBy("blk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).drop("kept")


#: Windows are compared as joined words; a word holds no space, so that the text of a window names it.
SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - {SIZE - 2})) AS i FROM w WHERE len(ws) >= {SIZE}
), h AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {SIZE - 1}], ' ') AS win FROM g
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM h
), c AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {SIZE})) AS p FROM m WHERE least < doc_id) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""
