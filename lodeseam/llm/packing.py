"""Packing of documents into fixed-length token sequences.

1. Tokens.  Every text is encoded once; ids are kept as packed integers in the
   shared folder.  The tokenizer splits at white space anyway, so that words
   are encoded once each and looked up afterwards.
2. Whole windows.  A document of at least ``window`` tokens gives full
   sequences of its own; what is left is a remainder shorter than a window.
3. Plan.  Remainders are counted by length, on a grid of ``grid`` tokens (a
   slot of k grid steps takes remainders of up to k * grid).  All combinations
   of up to three slots that fill a window exactly are enumerated, and
   non-negative least squares finds how often to use each so that the slots
   used match the histogram.  Repeat counts are rounded down, which never uses
   more remainders than there are.
4. Residuals.  What rounding leaves of the histogram is packed greedily, largest
   slots first, as long as a window is filled but for ``SLACK`` grid steps.  Sizes
   that nothing left can complete are laid end to end in windows and cut
   where a window ends, so that these windows have no padding at all.  The last
   one is split into sequences of powers of two, which need no padding either.
5. Assignment.  A remainder's rank among those of its slot size picks its
   place.  Ranks are counted within buckets of rows and offset by the buckets'
   totals, so that no length is ever ranked in one task.

What the driver holds is bounded by the grid: the histogram, the plan and the
bucket totals (at most ``window / grid`` numbers a bucket, of which there are
``BUCKETS``, and one for every ``PER_BUCKET`` documents beyond).

Odd input: null text: empty, and a document is then only the end id; null
doc_id stays null; repeated rows are packed as often as they stand; an empty
table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, ranges, scratch, slices, table, width

WINDOW, GRID, END_ID = 4096, 16, 2
BUCKETS, PER_BUCKET = 64, 1 << 22
#: Grid steps of a window that greedy packing may leave empty.
SLACK = 0
#: Words that a worker remembers at once; a word that was forgotten is encoded again.
REMEMBERED = 1_600_000
_PUNCTUATION = b",.;:!?%$&*#()[]{}\"-/\\+=_~^`@"
_MARK = "<|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts, by way of their words.

    The tokenizer drops white space and never joins across it, so that the ids
    of a text are those of its words.  Words seen before are found by their
    64-bit identity in sorted arrays.  A new word's ASCII punctuation at its end
    is a token run of its own after a letter, and ASCII letters are lower-cased
    anyway; so only stems are encoded, many at a time.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.stems: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.pool = np.zeros(0, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)

    def _encode(self, parts: list[bytes]) -> None:
        """Fills ``stems``.  A text of letters is one run, which ends with its one word-end token."""
        texts = [p.decode() for p in parts]
        plain = [t for t in texts if t.isalpha()]
        odd = [t for t in texts if not t.isalpha()]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):  # some letter decomposes
                odd += group
                continue
            for t, lo, hi in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                self.stems[t.encode()] = ids[lo:hi].tobytes()
        for t, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            self.stems[t.encode()] = np.array(e.ids, np.uint32).tobytes()

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        stem = word.rstrip(_PUNCTUATION)
        # the last letter must stay one in lower case, which a dotted capital I does not
        if not stem or b"<" in word or not (stem[-1:].isalpha() if stem[-1] < 128 else stem.decode()[-1].lower()[-1].isalpha()):
            return (word,)
        head = stem.lower() if stem.isascii() else stem
        return (head, word[len(stem) :]) if len(stem) < len(word) else (head,)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        split = [self._parts(w) for w in words]
        if len(self.stems) > REMEMBERED // 16:
            self.stems.clear()
        self._encode([p for p in {p for parts in split for p in parts} if p not in self.stems])
        coded = [self.stems[parts[0]] if len(parts) == 1 else self.stems[parts[0]] + self.stems[parts[1]] for parts in split]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), np.uint32).astype(self.pool.dtype)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at.astype(np.uint32)), np.insert(self.size, where, size.astype(np.uint32))

    def batch(self, column) -> list[np.ndarray]:
        """Ids of each text of a column, without any special token."""
        w = Words(column, NOT_SPACE)
        own, at, number = np.unique(w.ids(), return_index=True, return_inverse=True)
        k = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = k < len(self.keys)
        known[inside] = self.keys[k[inside]] == own[inside]
        if len(self.keys) + (~known).sum() > REMEMBERED:
            self.forget()
            known[:] = False
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = w.raw.tobytes()
            self._learn(own[fresh], [raw[a:b] for a, b in zip(w.start[at[fresh]].tolist(), w.end[at[fresh]].tolist(), strict=True)])
        k = np.searchsorted(self.keys, own)[number]
        size = self.size[k].astype(np.int64)
        ids = self.pool[ranges(self.at[k].astype(np.int64), size)].astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(size)])[w.first]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, kept from task to task with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row_no, n_tokens, ids (little-endian uint32, or uint16 if all fit), written to the shared folder."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [np.append(x, np.uint32(end_id)) for x in known.batch(batch.column("text"))]
                packed = [(x.astype(np.uint16) if x.max() < 1 << 16 else x).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    where = scratch(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")
    ids.withColumn("row_no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(where)
    return spark.read.parquet(where)


def fill(slots: np.ndarray, whole: int) -> np.ndarray:
    """All combinations of one to three of the slot sizes present that add up to ``whole`` grid steps, ascending, 0 for none."""
    have = np.flatnonzero(slots > 0)
    present = np.zeros(whole + 1, bool)
    present[have] = True
    out = [[0, 0, whole]] if present[whole] else []
    out += [[0, a, whole - a] for a in have if a <= whole - a and present[whole - a]]
    for a in have:
        b = have[(have >= a) & (have <= (whole - a) // 2)]
        c = whole - a - b
        good = present[c]
        out += np.stack([np.full(good.sum(), a), b[good], c[good]], 1).tolist()
    return np.array(out, np.int64).reshape(-1, 3)


def solve(combinations: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations with little squared error of slots used against the histogram.

    Accelerated projected gradient; slots beyond the histogram are then scaled
    away, and counts are rounded down, so that no slot is used too often.
    """
    n, size = len(combinations), len(histogram)
    if n == 0:
        return np.zeros(0, np.int64)
    rows = np.repeat(np.arange(n), 3)
    cols = combinations.ravel()
    real = cols > 0
    rows, cols = rows[real], cols[real]
    used = lambda x: np.bincount(cols, weights=x[rows], minlength=size)
    # diagonal scaling: a combination's column norm times how crowded its slots are
    crowd = np.bincount(cols, minlength=size).astype(float)
    step = 1.0 / np.maximum(1e-9, np.bincount(rows, weights=crowd[cols], minlength=n))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        gradient = np.bincount(rows, weights=(used(y) - histogram)[cols], minlength=n)
        new = np.maximum(0.0, y - step * gradient)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0.0, new + (t - 1) / after * (new - x))
        x, t = new, after
    over = np.maximum(1.0, used(x) / np.maximum(histogram, 1e-9))
    worst = np.ones(n)
    np.maximum.at(worst, rows, over[cols])
    counts = np.floor(x / worst + 1e-9).astype(np.int64)
    # what rounding left: take combinations once more while their slots last, best first
    left = histogram - used(counts.astype(float)).astype(np.int64)
    for i in np.argsort(-(x / worst - counts), kind="stable"):
        need = np.bincount(combinations[i], minlength=size)
        need[0] = 0
        k = int((left[need > 0] // need[need > 0]).min())
        if k > 0:
            counts[i] += k
            left -= k * need
    return counts


def greedy(left: np.ndarray, whole: int, slack: int) -> list[tuple[np.ndarray, int]]:
    """(times that a window takes each slot size, windows), largest slots first; slots that can't fill a window but for ``slack`` steps stay over.

    A window repeats until one of its sizes runs short, so that the rounds depend on the grid and not on the histogram's counts.
    """
    left, out = left.copy(), []
    left[0] = 0
    while len(have := np.flatnonzero(left)):
        need, room = np.zeros(len(left), np.int64), whole
        for slot in have[::-1]:
            need[slot] = min(int(left[slot]), room // int(slot))
            room -= int(need[slot] * slot)
        if room > slack:
            left[have[-1]] = 0
            continue
        n = int((left[need > 0] // need[need > 0]).min())
        left -= n * need
        out.append((need, n))
    return out


def _places(histogram: np.ndarray, whole: int) -> tuple[dict[str, np.ndarray], int, np.ndarray]:
    """Runs of slots: (slot, rank of the first, count, sequence of the first, position in the combination), sequences used, slots used by size."""
    combos = fill(histogram, whole)
    counts = solve(combos, histogram)
    used = np.bincount(combos.ravel(), weights=np.repeat(counts, 3), minlength=whole + 1).astype(np.int64)
    windows = [(combo[combo > 0], n) for combo, n in zip(combos, counts, strict=True)]
    windows += [(np.repeat(np.arange(whole + 1), need), n) for need, n in greedy(histogram - used, whole, min(SLACK, whole // 64))]
    rank = np.zeros(whole + 1, np.int64)
    rows, sequence = [], 0
    for combo, n in windows:
        if n:
            mine = combo[::-1]
            for place, slot in enumerate(mine):
                rows.append((slot, rank[slot], n, sequence, place))
                rank[slot] += n
            sequence += int(n)
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("slot", "from", "n", "sequence", "place"))}, sequence, rank


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, grid: int = GRID, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian uint32) of each piece."""
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer or default_tokenizer(), end_id)
    whole = window // grid
    buckets = max(BUCKETS, tokens.count() // PER_BUCKET)
    rows = tokens.select(
        "row_no", (F.col("n_tokens") % window).alias("rest"), F.expr(f"n_tokens div {window}").alias("full"), F.ceil((F.col("n_tokens") % window) / F.lit(grid)).cast("int").alias("slot"),
        F.pmod(F.xxhash64("row_no"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    # totals by slot and bucket: the histogram, and where each bucket's ranks begin
    totals = rows.groupBy("slot", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()
    histogram = np.bincount(totals["slot"], weights=totals["n"], minlength=whole + 1).astype(np.int64)
    histogram[0] = 0
    runs, sequences, used = _places(histogram, whole)
    counts = np.zeros((whole + 1, buckets), np.int64)
    fulls = np.zeros((whole + 1, buckets), np.int64)
    counts[totals["slot"], totals["bucket"]] = totals["n"]
    fulls[totals["slot"], totals["bucket"]] = totals["full"]
    before = np.cumsum(counts, 1) - counts
    fulls_before = (np.cumsum(fulls.ravel()) - fulls.ravel()).reshape(fulls.shape) + sequences
    base = spark.sparkContext.broadcast((runs, before, fulls_before, used))

    order = Window.partitionBy("slot", "bucket").orderBy("row_no")
    ranked = rows.select("row_no", "rest", "full", "slot", "bucket", (F.row_number().over(order) - 1).cast("long").alias("rank"), (F.sum("full").over(order) - F.col("full")).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before, fulls_before, used = base.value
        by = np.lexsort((runs["from"], runs["slot"]))
        sorted_runs = {k: v[by] for k, v in runs.items()}
        key = sorted_runs["slot"] << 44 | sorted_runs["from"]
        for batch in batches:
            get = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.schema.names}
            slot, bucket = get["slot"], get["bucket"]
            rank = get["rank"] + before[slot, bucket]
            slotted = (slot > 0) & (rank < used[slot])
            i = np.searchsorted(key, slot << 44 | rank, "right") - 1
            sequence, position = np.full(len(slot), -1), np.full(len(slot), -1)
            j = i[slotted]
            sequence[slotted] = sorted_runs["sequence"][j] + rank[slotted] - sorted_runs["from"][j]
            position[slotted] = sorted_runs["place"][j]
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("bucket"), pa.array(get["rest"]), pa.array(fulls_before[slot, bucket] + get["earlier"]), pa.array(sequence), pa.array(position)], ["row_no", "bucket", "rest", "full_sequence", "sequence", "place"])

    placed = ranked.mapInArrow(place, "row_no long, bucket int, rest long, full_sequence long, sequence long, place long")
    inside = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    slotted = placed.where("sequence >= 0").withColumn("at", F.coalesce(F.sum("rest").over(inside), F.lit(0)).cast("long"))
    # residuals, end to end: running totals within finer buckets, and of the buckets
    fine = max(buckets, 4 * width(spark))
    loose = placed.where("sequence < 0").withColumn("bucket", F.pmod(F.xxhash64("row_no", F.lit(1)), F.lit(fine)))
    along = Window.partitionBy("bucket").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    loose = loose.withColumn("at", F.coalesce(F.sum("rest").over(along), F.lit(0)).cast("long"))
    sums = loose.groupBy("bucket").agg(F.sum("rest").alias("tokens")).toPandas().sort_values("bucket")
    ahead = np.zeros(fine, np.int64)
    if len(sums):
        ahead[sums["bucket"].to_numpy(np.int64)] = np.cumsum(sums["tokens"]) - sums["tokens"]
    residual = int(sums["tokens"].sum()) if len(sums) else 0
    first_loose = sequences + int(fulls.sum())
    shift = spark.createDataFrame(pa.table({"b": np.arange(fine, dtype=np.int64), "ahead": ahead}).to_pandas())
    loose = loose.join(shift, F.col("bucket") == F.col("b")).withColumn("at", F.col("at") + F.col("ahead"))
    columns = ["row_no", "full_sequence", "sequence", "at"]
    plan = slotted.select(*columns).unionByName(loose.select(*columns))

    fields = pa.schema([(x.split()[0], pa.int64()) for x in _PIECES.split(", ")] + [("ids", pa.binary())] * with_ids)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = residual // window * window  # the last window is dealt in powers of two

        def residual_pieces(at: int, n: int) -> Iterator[tuple[int, int, int]]:
            """(length, sequence, offset) of n residual tokens that begin at ``at``."""
            while n:
                if at < last:
                    seq, off = first_loose + at // window, at % window
                    room = window - off
                else:
                    left, seq, low = residual - last, first_loose + last // window, last
                    while True:
                        power = 1 << (left.bit_length() - 1)
                        if at < low + power:
                            break
                        low, left, seq = low + power, left - power, seq + 1
                    off, room = at - low, low + power - at
                k = min(n, room)
                yield k, seq, off
                at, n = at + k, n - k

        for whole_batch in batches:
            for batch in slices(whole_batch, "ids"):
                out = []
                names = batch.schema.names
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    r = dict(zip(names, row, strict=True))
                    n = r["n_tokens"]
                    ids = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * n else np.uint32).astype("<u4")
                    spans = [(k * window, window, r["full_sequence"] + k, 0) for k in range(n // window)]
                    start, rest = n // window * window, n % window
                    if rest and r["sequence"] >= 0:
                        spans.append((start, rest, r["sequence"], r["at"]))
                    elif rest:
                        for k, seq, off in residual_pieces(r["at"], rest):
                            spans.append((start, k, seq, off))
                            start += k
                    for start, k, seq, off in spans:
                        piece = ids[start : start + k].tobytes()
                        out.append((r["doc_id"], start, k, zlib.crc32(piece), n, seq, off, piece)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), fields.types, strict=True)], schema=fields)

    return tokens.join(plan, "row_no").select("doc_id", "n_tokens", "ids", "full_sequence", "sequence", "at").mapInArrow(cut_up, _PIECES + ", ids binary" * with_ids)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
