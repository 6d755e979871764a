"""Fuzzy line dedup: shared runs of words, lossless bounds, edit similarity, connected groups.

A line is normalised to its words: runs of letters, digits and non-ASCII
characters, A-Z in lower case, every digit 0.  Lines of fewer than ``MIN_WORDS``
words (brackets and blank lines have none) are always kept.  Two lines are alike if the edit
similarity of their words, 1 - edits / words of the longer one, is at least
``LEAST``.  Of each connected group of like lines the first occurrence, by
(doc_id, line number), is kept.

Keys are not blocks of SimHash bits, as these can't hold the threshold: like lines
at 0.8 differ in a fifth of the bits, and blocks few enough to survive that are
shared by unlike lines too.  The pigeonholes are parts of the line itself: one edit
leaves one of its halves whole, so that up to nine words halves are keys; from
eight words on runs of three words are, the ``KEYS`` with the least hashes.  Of like
lines of up to 18 words none is missed; longer ones at similarity 0.8 agree in about
a third of their runs (a quarter, if the edits are spread evenly), so that about one
such pair in 1000 (100) shares no key, and fewer above it.

How classes of equal lines, links within buckets and their components are found is
described in ``likeness``.  What is lost, one row per document that loses lines,
joins the documents.

Odd input: null text: no lines; null doc_id: kept whole, and compared with none;
rows that repeat a doc_id are ordered by a hash of their text, and identical rows
are treated alike; a very long line is compared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, cut, mix, run_digest, slices, table, text_bytes, window_hash
from .likeness import Batch, classes, like_components, signatures, stored

MIN_WORDS, LEAST = 1, 0.8
#: Keys of a line, at most, and words in a run.
KEYS, RUN = 16, 3
#: Sizes up to which a join's side is broadcast: pairs of lines to align, bytes of lost line numbers.
FEW_PAIRS, FEW_BYTES = 500_000, 32 << 20

_U = np.uint64
_FOLD = LOWER.copy()
_FOLD[0x30:0x3A] = 0x30
#: Bits of a key; lines whose runs are chosen at once have a number of the other bits.
_KEY = 44


class Lines:
    """Lines of a batch of texts and their normalised words."""

    def __init__(self, column) -> None:
        column = column.cast(pa.large_binary())
        self.words = w = Words(column, ALNUM)
        self.raw = _FOLD[w.raw]
        w.raw = self.raw
        ends = np.flatnonzero(w.raw == 0x0A)
        # a line begins at each text's start and after each line feed
        starts = np.concatenate([w.offsets[:-1], ends + 1])
        owner = np.concatenate([np.arange(len(w.offsets) - 1), np.searchsorted(w.offsets, ends, "right") - 1])
        order = np.lexsort((starts, owner))
        self.start, self.text = starts[order], owner[order]
        self.first_line = np.searchsorted(self.text, np.arange(len(w.offsets)))
        self.number = np.arange(len(self.text)) - self.first_line[self.text]
        self.first = np.searchsorted(w.start, np.append(self.start, len(w.raw)))
        self.counts = np.diff(self.first)


def line_keys(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many keys each run of word identities has, all keys): like lines share one."""
    n = np.diff(first)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    short = np.flatnonzero((n >= 4) & (n <= 9))
    for size in np.unique(n[short]):
        rows = short[n[short] == size]
        words = ids[first[rows][:, None] + np.arange(size)]
        for h in sorted({int(size) // 2, (int(size) + 1) // 2}):
            for side, part in enumerate((words[:, :h], words[:, size - h :])):
                total = np.full(len(rows), 2 * h + side + 1, np.uint64)
                for k in range(h):
                    total = mix(total + part[:, k])
                lines.append(rows)
                keys.append(total >> _U(64 - _KEY))
    runs = window_hash(ids[first[0] : first[-1]], RUN)
    long = np.flatnonzero(n >= 8)
    for a in range(0, len(long), 1 << 20):
        rows = long[a : a + (1 << 20)]
        many = n[rows] - RUN + 1
        owner = np.repeat(np.arange(len(rows)), many)
        at = np.repeat(first[rows] - first[0] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.sort(owner.astype(np.uint64) << _U(_KEY) | runs[at] >> _U(64 - _KEY))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        owner = (both >> _U(_KEY)).astype(np.int64)
        least = np.arange(len(owner)) - np.searchsorted(owner, owner) < KEYS
        lines.append(rows[owner[least]])
        keys.append(both[least] & _U((1 << _KEY) - 1))
    line, key = np.concatenate(lines), np.concatenate(keys)
    return np.bincount(line, minlength=len(n)).astype(np.uint8), key[np.argsort(line, kind="stable")]


def line_batch(batch: pa.RecordBatch, min_words: int) -> Batch:
    """Lines of at least ``min_words`` words. batch: doc_id, row, text."""
    ls = Lines(batch.column("text"))
    ids = ls.words.ids()
    some = np.flatnonzero(ls.counts > 0)
    first = np.append(ls.first[:-1][some], ls.first[-1])  # lines without words take no room
    many, keys = line_keys(ids, first)
    doc, row = (batch.column(c).to_numpy()[ls.text[some]] for c in ("doc_id", "row"))
    all_lines = Batch(run_digest(ids, first, 17), run_digest(ids, first, 91), ls.counts[some].astype(np.int32), signatures(ids, first), many, keys, doc, row, ls.number[some].astype(np.int32))
    return all_lines if min_words <= 1 else all_lines.take(np.flatnonzero(all_lines.n >= min_words))


def _line_words(docs: DataFrame, places: DataFrame):
    """What ``like_components`` fetches: the words of the lines of pairs, read from their documents."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(picked: list[tuple]) -> pa.RecordBatch:
            text, ids, blocks = (list(c) for c in zip(*picked, strict=True))
            w = Words(pa.array(text, pa.large_binary()), ALNUM)
            w.raw = _FOLD[w.raw]
            words = (w.ids() & _U(0xFFFFFFFF)).astype(np.uint32)
            packed = [words[lo:hi].tobytes() for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
            many = [len(x) for x in blocks]
            return pa.RecordBatch.from_arrays([pa.array([x for one in blocks for x in one], pa.int32()), pa.array(np.repeat(ids, many), pa.int64()), pa.array([x for x, k in zip(packed, many, strict=True) for _ in range(k)], pa.binary())], ["block", "id", "words"])

        for whole in batches:
            picked, size = [], 0
            for text, lines in zip(whole.column("text"), whole.column("lines"), strict=True):
                parts = text.as_py().encode().split(b"\n")
                for x in lines.as_py():
                    picked.append((parts[x["line"]], x["id"], x["blocks"]))
                    size += len(parts[x["line"]]) * len(x["blocks"])
                    if size > 2 << 20:
                        yield flush(picked)
                        picked, size = [], 0
            if picked:
                yield flush(picked)

    def fetch(ends: DataFrame, n: int) -> DataFrame:
        wanted = ends.groupBy("id").agg(F.collect_list("block").alias("blocks")).join(places, "id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "id", "blocks")).alias("lines"))
        texts = docs.join(F.broadcast(cut(wanted)) if n <= FEW_PAIRS else wanted, ["doc_id", "row"]).select("text", "lines")
        return texts.mapInArrow(extract, "block int, id long, words binary")

    return fetch


def lost_lines(docs: DataFrame, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, row, lines: numbers, from 0, of the lines that each document loses. docs: doc_id, row, text."""
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = stored(classes(named, lambda whole: (line_batch(part, min_words) for part in slices(whole, "text", 1 << 20)), text_bytes(named, "text"), 1 / 16), "lines")
    first = rows.where("NOT lost")
    found = like_components(first.select("id", "n", "sig", "keys"), _line_words(named, first.select("id", "doc_id", "row", "line")), least)
    grouped = first.join(found.withColumnRenamed("node", "id"), "id").select("root", F.struct("doc_id", "row", "line").alias("at"))
    keep = grouped.groupBy("root").agg(F.min("at").alias("keep"))
    later = grouped.join(keep, "root").where("at <> keep").select("at.*")
    lost = rows.where("lost").select("doc_id", "row", "line").unionByName(later)
    return lost.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, least: float = LEAST) -> DataFrame:
    """All columns of ``docs`` (text replaced by what is kept of it), n_lines and n_removed."""
    fields = docs.schema.names
    docs = docs.withColumn("row", F.xxhash64("text")) if "row" not in fields else docs.withColumnRenamed("row", "_row_").withColumn("row", F.xxhash64("text"))
    own = [c for c in docs.schema.names if c not in ("row", "text")]
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.col("text").cast("string").alias("text"))
    lost = stored(lost_lines(judged, min_words, least).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_text"), "lines"), "lost")
    size = lost.agg(F.sum(F.size("lines") * 4 + 64)).first()[0] or 0
    lost = F.broadcast(lost) if size <= FEW_BYTES else lost
    joined = docs.select(F.col("text").cast("string").alias("text"), F.struct(*own).alias("own"), "row").join(lost, (F.col("own.doc_id").cast("long") == F.col("_doc")) & (F.col("row") == F.col("_text")), "left").select("own", "text", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 19)):
            texts, total, removed = [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                if lines:
                    gone = set(lines)
                    text = "\n".join(p for i, p in enumerate(parts) if i not in gone)
                texts.append(text)
                total.append(len(parts))
                removed.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["own", "text", "n_lines", "n_removed"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([joined.schema["own"]]).add("text", StringType()).add("n_lines", LongType()).add("n_removed", LongType())
    out = joined.mapInArrow(drop, schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"own.`{'_row_' if c == 'row' else c}`").alias(c) for c in fields), "n_lines", "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
