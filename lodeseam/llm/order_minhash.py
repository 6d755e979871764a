"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case;
k-mers are runs of five words, labelled with their occurrence number in the
document.  Two documents are near copies if their word edit similarity,
1 - edits / words of the longer one, is at least 0.8.

1. Documents of the same words are one class, represented by the least doc_id.
   What follows sees representatives only.
2. Each of ``HASHES`` hash functions samples the two labelled k-mers with the
   least values and keeps them in text order: that pair is a key.  Documents
   agree in a key the likelier the smaller their edit distance.  Edits leave few
   k-mers of a short text whole, so that texts of fewer than 400 words have keys of
   three words besides, of fewer than 160 of two, and of fewer than 12 of one
   (``SHORTER``).  At similarity 0.8 with edits at random places at least 95 in 100
   pairs share a key below 400 words, about 9 in 10 above, at 0.85 nearly all.
   (Edits that hit every fifth word of a longer text leave no common run of five.)
3. Keys that only one class has are dropped by a sketch; classes are dealt by the
   others, linked within buckets and verified by alignment, and where a link
   fails its components are searched again, so that the groups are those of all
   pairs within buckets (see ``likeness``).
4. Connected components of verified links are the groups.

Odd input: null text: no words; documents without words are no copies of each
other; fewer than five words: only equal word sequences match; null doc_id: kept
and never grouped; rows that repeat a doc_id are one document that holds each of
their texts; very long texts are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, cut, mix, run_digest, slices, table, text_bytes, window_hash
from .likeness import KEY_BITS, Batch, classes, like_components, signatures, stored

SHINGLE, HASHES, LEAST = 5, 64, 0.8
#: (words of a k-mer, texts of fewer words that have keys of them, keys)
SHORTER = ((3, 400, 16), (2, 160, 32), (1, 12, 16))
#: Pairs up to which the ends to align are broadcast.
FEW_PAIRS = 250_000

_U = np.uint64


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def sketch(w: Words, ids: np.ndarray, hashes: int = HASHES, shingle: int = SHINGLE, only: np.ndarray | None = None) -> np.ndarray:
    """Keys of each text (or of those that ``only`` marks), (texts, hashes); zeros where a text has no k-mer."""
    n = len(w.counts)
    keys = np.zeros((n, hashes), np.uint64)
    x = window_hash(ids, shingle, salt=shingle if shingle != SHINGLE else 0)
    inside = w.doc[: len(x)] == w.doc[shingle - 1 :][: len(x)]
    inside = np.flatnonzero(inside if only is None else inside & only[w.doc[: len(x)]])
    if not len(inside):
        return keys
    x, doc = x[inside], w.doc[inside]
    # occurrence numbers: equal k-mers of a document, in text order
    own = x + doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(own, kind="stable")
    new = np.append(True, own[order][1:] != own[order][:-1])
    at = np.flatnonzero(new)
    nth = np.empty(len(x), np.uint64)
    nth[order] = (np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))).astype(np.uint64)
    x = mix(x + nth * _U(0xE7037ED1A0B428DB))
    have, first = np.unique(doc, return_index=True)
    counts = np.diff(np.append(first, len(x)))
    several = np.repeat(counts > 1, counts)
    for j, a in enumerate(_multipliers(hashes)):
        y = x * a
        least = np.minimum.reduceat(y, first)
        p = np.flatnonzero(y == np.repeat(least, counts))
        p = p[np.append(True, doc[p][1:] != doc[p][:-1])]
        y[p] = _U(0xFFFFFFFFFFFFFFFF)
        least = np.minimum.reduceat(y, first)
        q = np.flatnonzero((y == np.repeat(least, counts)) & several)
        q = q[np.append(True, doc[q][1:] != doc[q][:-1])[: len(q)]]
        second = p.copy()
        second[counts > 1] = q
        early, late = np.minimum(p, second), np.maximum(p, second)
        keys[have, j] = mix(mix(x[early]) + x[late] * _U(3) + _U(j + 1)) | _U(1)
    return keys


def document_batch(batch: pa.RecordBatch) -> Batch:
    """Documents with words. batch: doc_id, row, text."""
    w = Words(batch.column("text"), ALNUM, lower=True)
    ids = w.ids()
    some = np.flatnonzero(w.counts > 0)
    first = np.append(w.first[:-1][some], w.first[-1])
    # of a short text, edits leave few k-mers whole: it has keys of shorter ones besides
    keys = np.concatenate([sketch(w, ids), *(sketch(w, ids, hashes, size, w.counts < most) for size, most, hashes in SHORTER)], 1)[some]
    have = keys != 0
    doc, row = (batch.column(c).to_numpy()[some] for c in ("doc_id", "row"))
    return Batch(run_digest(ids, first, 17), run_digest(ids, first, 91), w.counts[some].astype(np.int32), signatures(ids, first), have.sum(1).astype(np.uint8), keys[have] >> _U(64 - KEY_BITS), doc, row, np.zeros(len(some), np.int32))


def _document_words(docs: DataFrame, places: DataFrame):
    """What ``like_components`` fetches: the words of the documents of pairs."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 19)):
            w = Words(batch.column("text"), ALNUM, lower=True)
            ids = (w.ids() & _U(0xFFFFFFFF)).astype(np.uint32)
            for ends, lo, hi in zip(batch.column("ends").to_pylist(), w.first[:-1], w.first[1:], strict=True):
                words, all_ends = ids[lo:hi].tobytes(), [(x["id"], block) for x in ends for block in x["blocks"]]
                for at in range(0, len(all_ends), step := max(1, (4 << 20) // (len(words) + 1))):
                    part = all_ends[at : at + step]
                    yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in part], pa.int32()), pa.array([x[0] for x in part], pa.int64()), pa.array([words] * len(part), pa.binary())], ["block", "id", "words"])

    def fetch(ends: DataFrame, n: int) -> DataFrame:
        wanted = ends.groupBy("id").agg(F.collect_list("block").alias("blocks")).join(places, "id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("id", "blocks")).alias("ends"))
        texts = docs.join(F.broadcast(cut(wanted)) if n <= FEW_PAIRS else wanted, ["doc_id", "row"]).select("text", "ends")
        return texts.mapInArrow(extract, "block int, id long, words binary")

    return fetch


def near_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (least doc_id of the same words), group_id (least doc_id of the near-copy group), kept: one row per doc_id, and one for each null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    rows = stored(classes(named.where("text IS NOT NULL"), lambda whole: (document_batch(part) for part in slices(whole, "text", 1 << 19)), text_bytes(named, "text"), HASHES / 1500), "documents")
    first = rows.where("NOT lost")
    known = rows.where("id IS NOT NULL").select("doc_id", "row", "id", F.col("rep_doc").alias("class_id"))
    dropped = rows.where("id IS NULL").select("doc_id", "rep_doc", "rep_row")
    reps = known.select(F.col("doc_id").alias("rep_doc"), F.col("row").alias("rep_row"), "id", "class_id")
    member = stored(known.select("doc_id", "id", "class_id").unionByName(dropped.join(reps, ["rep_doc", "rep_row"]).select("doc_id", "id", "class_id")).distinct(), "members")
    # a doc_id that repeats may be in several classes, which it links
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_most")).where("a <> _most").select("doc_id", "a")
    same = several.join(member, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
    found = like_components(first.select("id", "n", "sig", "keys"), _document_words(named, first.select("id", "doc_id", "row")), least, same)
    rooted = first.select("id", "doc_id").join(found.withColumnRenamed("node", "id"), "id")
    groups = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select(F.col("id").alias("_id"), "group_id")
    grouped = member.join(groups, F.col("id") == F.col("_id"), "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("group_id", "class_id")).alias("group_id"))
    bare = named.select("doc_id").distinct().join(grouped.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"))
    null = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("group_id"))
    return grouped.unionByName(bare).unionByName(null).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
