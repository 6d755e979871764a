"""Like pairs among very many word sequences: classes of equal ones, shared keys, lossless bounds, alignment.

Two sequences are alike if the edit similarity of their words, 1 - edits / words of
the longer one, is at least a threshold.  Callers give every sequence a few keys, of
which like sequences share one (how surely, is the caller's choice of keys).

1. ``classes``: equal sequences (128-bit digest) are one class.  A batch sends the
   first of its equal ones to the digest's shard, so that a hot sequence is one
   message per batch.  Before keys go anywhere, a sketch in shards of the key
   space counts them: cells can only be counted too high, so that a key that two
   classes share is never dropped, and most others are.
2. ``near_links``: classes are dealt by shared key.  Within a bucket, pairs are
   judged by what can't exclude like sequences: lengths, and counts of words in
   hashed cells, of which an edit moves two at most.  Of the pairs that remain
   only a spanning forest, the most similar first, is sent on, so that the
   output is linear in a bucket's classes; crowds of near copies are linked to a pivot
   and not compared with each other.  A bucket of more than ``HOT`` classes is
   dealt into cells, each of which holds two of its parts, so that no task holds it.
3. ``aligned``: the linked sequences' words meet in blocks of pairs and are aligned in
   a band around the diagonal, many pairs at once.
4. ``like_components``: where a link fails that may have stood for others, the
   components which it would have joined are searched again, once: their members meet
   in their buckets with all their words, and pairs of components that are still apart are
   aligned there, the most similar first, until none is untried.  What an alignment joins
   needs no other, and only links that join are sent on.  Large buckets, as of lines from one template, are split by their
   members' rarest words first, so that pairs that share the template alone are not met.  So the components are those of all pairs within buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, pack_sorted, ranges, scratch, tidy, unpack_sorted, width
from .components import components, joined_roots

_U = np.uint64
#: Classes of a bucket that one task compares with each other, and classes of a part of a larger one.
HOT, PART = 4096, 2048
#: log2 of the cells of a shard of the key sketch; key bits that buckets are told apart by.
CELL_BITS, KEY_BITS = 24, 48
#: Pairs that a repeated search aligns at once at first, by what that grows, and at most.
FIRST, MORE, MOST = 4, 64, 4096
#: Cells of the signatures that repeated searches use, and members of a bucket that these split first.
WIDE, LARGE = 4096, 64
#: Pivots that a bucket of more than ``LARGE`` is tried with at once, least members of a crowd around one, and members that others are compared with for a closer link.
PIVOTS, CROWD, NEARBY = 16, 16, 64
#: Shards that few keys are dealt into at most: a crowd that shares many keys has links in each of them.
SHARDS = 24
#: Sequences and keys that a task holds before it sends them.
SENT = 1 << 20
_NONE = 1 << 30


def _table(rows: list[tuple], fields: list[pa.Field]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _touched(sorted_place: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the shards that sorted places name: no others are looked at, however many there are."""
    at = np.flatnonzero(np.append(True, sorted_place[1:] != sorted_place[:-1])[: len(sorted_place)])
    return list(zip(sorted_place[at].tolist(), at.tolist(), np.append(at[1:], len(sorted_place))[: len(at)].tolist(), strict=True))


# ---------------------------------------------------------------- signatures


def sig_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a signature, by the number of words of its sequence: two planes of 64, 256 or 512 cells."""
    return np.where(n <= 24, 2, np.where(n <= 100, 8, 16))


def signatures(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures of the runs [first[i], first[i + 1]) of word identities, one after another.

    A signature counts words, modulo 4, in cells that a hash of the word names; the
    low bits of all cells come first, then the high ones.  The fourth occurrence of a
    word and those after it take other cells, three each, so that a word which
    repeats is never counted away.
    """
    n = np.diff(first)
    size = sig_words(n)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    begin = first[:-1] - first[0]
    ids = ids[first[0] : first[-1]]
    place = (mix(ids + _U(5)) & _U(511)).astype(np.int64)
    for words in (2, 8, 16):
        mine, cells = np.flatnonzero(size == words), 32 * words
        for a in range(0, len(mine), max(1, (1 << 19) // cells)):
            rows = mine[a : a + max(1, (1 << 19) // cells)]
            where, base = ranges(begin[rows], n[rows]), np.repeat(np.arange(len(rows)) * cells, n[rows])
            cell = place[where]
            counts = np.bincount(base + (cell & (cells - 1)), minlength=len(rows) * cells)
            full = np.flatnonzero(np.repeat((counts.reshape(len(rows), cells) > 3).any(1), n[rows]))
            if len(full):
                later, at_word = _later(base[full].astype(np.uint64) << _U(32) | ids[where[full]] >> _U(32))
                again = full[at_word]
                cell[again] = (mix(ids[where[again]] + _U(5) + later * _U(0xE7037ED1A0B428DB)) & _U(511)).astype(np.int64)
                counts = np.bincount(base + (cell & (cells - 1)), minlength=len(rows) * cells)
            counts = counts.astype(np.uint8).reshape(len(rows), cells)
            planes = [np.packbits(counts >> k & 1, axis=1, bitorder="little").view(np.uint64) for k in (0, 1)]
            out[(at[rows][:, None] + np.arange(words)).ravel()] = np.concatenate(planes, 1).ravel()
    return out


def _later(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which three of its occurrences, from 1, places) of every fourth and later occurrence of a word."""
    order = np.argsort(words, kind="stable")
    at = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
    many = np.diff(np.append(at, len(words)))
    often = many > 3
    nth = ranges(np.zeros(often.sum(), np.int64), many[often])
    later = nth > 2
    return (nth[later] // 3).astype(np.uint64), order[ranges(at[often], many[often])[later]]


def _folded(low: np.ndarray, high: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes with cells added up, modulo 4, of ``parts`` equal parts."""
    low, high = (x.reshape(len(x), parts, x.shape[1] // parts) for x in (low, high))
    a, b = low[:, 0], high[:, 0]
    for k in range(1, parts):
        a, b = a ^ low[:, k], b ^ high[:, k] ^ (a & low[:, k])
    return a, b


def _apart(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Sum over cells of how far their counts are apart, at least, from counts modulo 4."""
    odd = a[0][i] ^ b[0][j]
    return np.bitwise_count(odd).sum(-1, dtype=np.int32) + 2 * np.bitwise_count((a[1][i] ^ b[1][j]) & ~odd).sum(-1, dtype=np.int32)


class Signatures:
    """Signatures of many sequences, ready to be compared; n: numbers of words."""

    def __init__(self, stream: np.ndarray, n: np.ndarray, least: float) -> None:
        self.n, self.least = n.astype(np.int32), least
        size = sig_words(self.n)
        at = np.cumsum(size) - size
        self.tier = np.where(size == 2, 0, np.where(size == 8, 1, 2)).astype(np.int8)
        small, mid, full = (np.flatnonzero(size == k) for k in (2, 8, 16))
        cut_out = lambda rows, k: (stream[at[rows][:, None] + np.arange(k // 2)], stream[at[rows][:, None] + np.arange(k // 2, k)])
        self.full = cut_out(full, 16)
        self.mid = tuple(np.concatenate(x) for x in zip(cut_out(mid, 8), _folded(*self.full, 2), strict=True))
        #: row in mid and full of each sequence that has one
        self.row = np.zeros(len(n), np.int64)
        self.row[mid], self.row[full], self.first_full = np.arange(len(mid)), len(mid) + np.arange(len(full)), len(mid)
        self.narrow = tuple(np.zeros((len(n), 1), np.uint64) for _ in range(2))
        for plane, own, wide in zip(self.narrow, cut_out(small, 2), _folded(*self.mid, 4), strict=True):
            plane[small] = own
            plane[np.concatenate([mid, full])] = wide

    def gathered(self, idx: np.ndarray) -> list[np.ndarray]:
        """What a first look at sequences needs, for ``weight``."""
        return [self.n[idx], self.narrow[0][idx, 0], self.narrow[1][idx, 0]]

    def limit(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What like sequences of n and m words are apart at most; negative if none can be alike."""
        edits, longer = (np.maximum(n, m) * (1 - self.least) + 1e-9).astype(np.int32), np.abs(n - m)
        return np.where(longer <= edits, 2 * edits - longer, np.int32(-1))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What sequences are apart at least, however far that is: a metric among those whose finest shared signatures have one size."""
        out = _apart(self.narrow, a, self.narrow, b)
        for tier, planes, shift in ((1, self.mid, 0), (2, self.full, self.first_full)):
            both = np.flatnonzero((self.tier[a] >= tier) & (self.tier[b] >= tier))
            out[both] = _apart(planes, self.row[a[both]] - shift, planes, self.row[b[both]] - shift)
        return out

    def weight(self, a: np.ndarray, b: np.ndarray, seen: tuple[list, list] | None = None) -> np.ndarray:
        """Words that one has and the other lacks, at least, and the same the other way; _NONE where the pair can't be alike. a and b are index arrays that broadcast.

        An edit moves two words at most, one if it changes the length; so the sum and
        the difference in length are at most twice the edits.
        """
        (n, low_a, high_a), (m, low_b, high_b) = seen or (self.gathered(a), self.gathered(b))
        limit = self.limit(n, m)
        odd = low_a ^ low_b
        out = np.bitwise_count(odd) + 2 * np.bitwise_count((high_a ^ high_b) & ~odd)
        possible = out <= limit
        out = np.where(possible, out, np.int32(_NONE))
        where = np.nonzero(possible)
        x, y = (np.broadcast_to(v, out.shape)[where] for v in (a, b))
        wide = np.flatnonzero((self.tier[x] > 0) & (self.tier[y] > 0))
        if len(wide):
            where, x, y = tuple(v[wide] for v in where), x[wide], y[wide]
            most = limit[where]
            d = _apart(self.mid, self.row[x], self.mid, self.row[y])
            longest = np.flatnonzero((d <= most) & (self.tier[x] == 2) & (self.tier[y] == 2))
            if len(longest):
                d[longest] = _apart(self.full, self.row[x[longest]] - self.first_full, self.full, self.row[y[longest]] - self.first_full)
            out[where] = np.where(d <= most, d, _NONE)
        return out


# ---------------------------------------------------------------- classes

_SENT = [pa.field("shard", pa.int32()), *(pa.field(c, pa.binary()) for c in ("hi", "lo", "n", "sig", "many", "keys", "doc", "row", "line"))]
_SENT_DDL = "shard int, hi binary, lo binary, n binary, sig binary, many binary, keys binary, doc binary, row binary, line binary"
_OUT = pa.schema([("lost", pa.bool_()), ("id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("keys", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("rep_doc", pa.int64()), ("rep_row", pa.int64())])
_OUT_DDL = "lost boolean, id long, n int, sig binary, keys binary, doc_id long, row long, line int, rep_doc long, rep_row long"
_MSG = [pa.field("blk", pa.int32()), pa.field("shard", pa.int64()), pa.field("data", pa.binary())]
_MSG_DDL = "blk int, shard long, data binary"


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8")[:, 0].astype(np.uint64)


def _blobs(stream: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value of each run of ``counts`` items."""
    offsets = np.concatenate([[0], np.cumsum(counts * stream.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(stream.tobytes())])


def _stream(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


class Batch:
    """Sequences of a batch of texts: digests, word counts, signatures, keys (``many`` of each) and where they stand."""

    def __init__(self, hi, lo, n, sig, many, keys, doc, row, line) -> None:
        self.hi, self.lo, self.n, self.sig, self.many, self.keys, self.doc, self.row, self.line = hi, lo, n, sig, many, keys, doc, row, line

    @staticmethod
    def joined(parts: list[Batch]) -> Batch:
        return Batch(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("hi", "lo", "n", "sig", "many", "keys", "doc", "row", "line")))

    def take(self, i: np.ndarray) -> Batch:
        size, many = sig_words(self.n), self.many.astype(np.int64)
        sig = self.sig[ranges((np.cumsum(size) - size)[i], size[i])]
        keys = self.keys[ranges((np.cumsum(many) - many)[i], many[i])]
        return Batch(self.hi[i], self.lo[i], self.n[i], sig, self.many[i], keys, self.doc[i], self.row[i], self.line[i])

    def first_of_equal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the first occurrence of each digest, in order of it; of the others at other places; and of the first of each of these."""
        order = np.lexsort((self.line, self.row, self.doc, self.lo, self.hi))
        hi, lo = self.hi[order], self.lo[order]
        new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))[: len(order)]
        first = order[new]
        head = first[np.cumsum(new) - 1] if len(first) else order
        elsewhere = (self.doc[order] != self.doc[head]) | (self.row[order] != self.row[head]) | (self.line[order] != self.line[head])
        return first, order[elsewhere], head[elsewhere]

    def messages(self, shards: int) -> list[tuple]:
        """What goes to each digest shard, and at random: occurrences lost already, with their first."""
        first, rest, head = self.first_of_equal()
        own = self.take(first)
        place = (mix(own.hi) % _U(shards)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        own = own.take(order)
        s_at = np.concatenate([[0], np.cumsum(sig_words(own.n))])
        k_at = np.concatenate([[0], np.cumsum(own.many.astype(np.int64))])
        out = [
            (s, own.hi[a:b].tobytes(), own.lo[a:b].tobytes(), own.n[a:b].astype(np.int32).tobytes(), own.sig[s_at[a] : s_at[b]].tobytes(), own.many[a:b].astype(np.uint8).tobytes(), _six(own.keys[k_at[a] : k_at[b]]), own.doc[a:b].tobytes(), own.row[a:b].tobytes(), own.line[a:b].tobytes())
            for s, a, b in _touched(place[order])
        ]
        if len(rest):
            place = (mix(self.doc[rest].view(np.uint64)) % _U(shards)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            rest, head = rest[order], head[order]
            reps = np.stack([self.doc[head], self.row[head]], 1)
            out += [(s, b"", b"", b"", reps[a:b].tobytes(), b"", b"", self.doc[rest[a:b]].tobytes(), self.row[rest[a:b]].tobytes(), self.line[rest[a:b]].tobytes()) for s, a, b in _touched(place[order])]
        return out


def _received(rows: pa.Table) -> tuple[Batch, list[tuple]]:
    kept, lost = [], []
    for hi, lo, n, sig, many, keys, doc, row, line in zip(*(rows.column(f.name).to_pylist() for f in _SENT[1:]), strict=True):
        place = np.frombuffer(doc, np.int64), np.frombuffer(row, np.int64), np.frombuffer(line, np.int32)
        if hi:
            kept.append(Batch(np.frombuffer(hi, np.uint64), np.frombuffer(lo, np.uint64), np.frombuffer(n, np.int32), np.frombuffer(sig, np.uint64), np.frombuffer(many, np.uint8), _of_six(keys), *place))
        else:
            lost.append((*place, np.frombuffer(sig, np.int64).reshape(-1, 2)))
    none = Batch(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, np.uint64, np.uint8, np.uint64, np.int64, np.int64, np.int32)))
    return (Batch.joined(kept) if kept else none), lost


def _sketch_shape(keys: float, least_shards: int) -> tuple[int, int]:
    """(bits of a cell number, bits of it that name the shard): 32 cells a key, CELL_BITS cells a shard at most."""
    bits = min(KEY_BITS, max(CELL_BITS, int(np.ceil(np.log2(max(1.0, keys)))) + 5))
    return bits, max(bits - CELL_BITS, min(bits, int(np.ceil(np.log2(max(1, least_shards))))))


def classes(docs: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Batch]], text_size: int, keys_per_byte: float) -> DataFrame:
    """lost, id, n, sig, keys, doc_id, row, line, rep_doc, rep_row of every occurrence of a sequence.

    ``read`` makes Batches of a record batch, one after another.  The first occurrence of each class is
    not lost and has its signature and those of its keys that other classes seem to
    share, with the number of parts to deal such a bucket into in the top 16 bits
    (no signature if there is none).  rep_doc and rep_row name the class's first row;
    an occurrence that its batch dropped has no id, and names the batch's first.
    """
    spark = docs.sparkSession
    shards = max(width(spark), -(-text_size // (64 << 20)))
    bits, shard_bits = _sketch_shape(text_size * keys_per_byte, shards)
    cell = _U(bits - shard_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held, size = [], 0
            for part in read(whole):
                held.append(part)
                size += len(part.hi) + len(part.keys)
                if size >= SENT:
                    yield from _table(Batch.joined(held).messages(shards), _SENT).to_batches()
                    held, size = [], 0
            if held:
                yield from _table(Batch.joined(held).messages(shards), _SENT).to_batches()
            del held
            tidy()

    def cells_of(c: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells in order, each key's place among them, and how many keys of this shard touch each."""
        own = mix(c.keys) >> _U(64 - bits)
        return np.unique(own, return_inverse=True, return_counts=True)

    def sketch(rows: pa.Table) -> pa.Table:
        c, _ = _received(rows)
        blk = rows.column("shard")[0].as_py()
        cells, _, counts = cells_of(c.take(c.first_of_equal()[0]))
        name = (cells >> cell).astype(np.int64)
        touched, at = np.unique(name, return_index=True)
        low = cells & ((_U(1) << cell) - _U(1))
        out = []
        for s, a, b in zip(touched.tolist(), at, np.append(at[1:], len(name))[: len(at)], strict=True):
            packed = pack_sorted(low[a:b])
            out.append((blk, s, len(packed).to_bytes(4, "little") + packed + zlib.compress(np.minimum(counts[a:b], 65535).astype(np.uint16).tobytes(), 1)))
        del c, cells, counts, low, name
        tidy()
        return _table(out, _MSG)

    def count(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << int(cell), np.uint32)
        sent = []
        for x in rows.column("data"):
            data = x.as_py()
            n = int.from_bytes(data[:4], "little")
            own = unpack_sorted(data[4 : 4 + n])
            total[own] += np.frombuffer(zlib.decompress(data[4 + n :]), np.uint16)
            sent.append(own)
        shard = rows.column("shard")[0].as_py()
        out = []
        for blk, own in zip(rows.column("blk").to_pylist(), sent, strict=True):
            touching = total[own].astype(np.int64)  # of the cells sent alone: a shard has far more
            parts = np.where(touching <= 1, 0, np.where(touching <= HOT, 1, -(-touching // PART))).astype(np.uint16)
            out.append((blk, shard, zlib.compress(parts.tobytes(), 1)))
        del total, sent
        tidy()
        return _table(out, _MSG)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _OUT.empty_table()
        c, lost = _received(rows)
        blk = rows.column("shard")[0].as_py()
        first, rest, head = c.first_of_equal()
        out = []
        if len(first):
            rank = np.empty(len(c.hi), np.int64)
            rank[first] = np.arange(len(first))
            own = c.take(first)
            cells, place, _ = cells_of(own)
            name = (cells >> cell).astype(np.int64)
            parts = np.zeros(len(cells), np.uint16)
            for s, x in zip(answers.column("shard").to_pylist(), answers.column("data"), strict=True):
                a, b = np.searchsorted(name, s), np.searchsorted(name, s, "right")
                parts[a:b] = np.frombuffer(zlib.decompress(x.as_py()), np.uint16)
            parts = parts[place]
            many = own.many.astype(np.int64)
            shared = parts > 0
            kept = np.bincount(np.repeat(np.arange(len(many)), many)[shared], minlength=len(many))
            size = np.where(kept > 0, sig_words(own.n), 0)
            s_at = np.cumsum(sig_words(own.n)) - sig_words(own.n)
            ids = (np.int64(blk) << 36) + np.arange(len(first))
            out.append(pa.table([pa.array(np.zeros(len(first), bool)), ids, own.n.astype(np.int32), _blobs(own.sig[ranges(s_at, size)], size), _blobs(own.keys[shared] | parts[shared].astype(np.uint64) << _U(KEY_BITS), kept), own.doc, own.row, own.line, own.doc, own.row], schema=_OUT))
            lost = [*lost, (c.doc[rest], c.row[rest], c.line[rest], np.stack([c.doc[head], c.row[head], (np.int64(blk) << 36) + rank[head]], 1))]
        for doc, row, line, rep in lost:
            blank, none = pa.nulls(len(doc), pa.binary()), pa.nulls(len(doc), pa.int64())
            out.append(pa.table([pa.array(np.ones(len(doc), bool)), rep[:, 2].copy() if rep.shape[1] > 2 else none, pa.nulls(len(doc), pa.int32()), blank, blank, doc, row, line, rep[:, 0].copy(), rep[:, 1].copy()], schema=_OUT))
        del c, lost
        tidy()
        return pa.concat_tables(out)

    sent = docs.mapInArrow(send, _SENT_DDL).repartition(width(spark), "shard")
    answers = sent.groupBy("shard").applyInArrow(sketch, _MSG_DDL).groupBy("shard").applyInArrow(count, _MSG_DDL)
    return sent.groupBy("shard").cogroup(answers.repartition(width(spark), "blk").groupBy("blk")).applyInArrow(finish, _OUT_DDL)


# ---------------------------------------------------------------- links within buckets

_KEYED = [pa.field("shard", pa.int32()), *(pa.field(c, pa.binary()) for c in ("key", "id", "n", "sig", "root", "words"))]
_KEYED_DDL = "shard int, key binary, id binary, n binary, sig binary, root binary, words binary"


def _dealt(rows: DataFrame, shards: int):
    """Classes (id, n, sig, keys and perhaps root, words), packed, once for each key or cell of a hot one, grouped by shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            n = batch.column("n").to_numpy().astype(np.int64)
            many = np.array([len(x) // 8 for x in batch.column("keys").to_pylist()])
            keys, sig, ids = _stream(batch.column("keys"), np.uint64), _stream(batch.column("sig"), np.uint64), batch.column("id").to_numpy()
            owner = np.repeat(np.arange(len(n)), many)
            parts = (keys >> _U(KEY_BITS)).astype(np.int64)
            keys = keys & _U((1 << KEY_BITS) - 1)
            if (parts > 1).any():
                # a part meets every part of its bucket in a cell of the two
                times = np.where(parts > 1, parts, 1)
                other = ranges(np.zeros(len(keys), np.int64), times)
                keys, owner, parts = (np.repeat(x, times) for x in (keys, owner, parts))
                mine = (mix(ids[owner].view(np.uint64) + _U(77)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
                cell = (np.minimum(mine, other) << 16 | np.maximum(mine, other)).astype(np.uint64) + _U(1)
                keys = np.where(parts > 1, mix(keys + cell * _U(0x9E3779B97F4A7C15)), keys)
            place = (mix(keys) % _U(shards)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            touched = _touched(place[order])
            owner, keys = owner[order], keys[order]
            size = sig_words(n)
            s_at = np.cumsum(size) - size
            words = [len(k).to_bytes(4, "little") + k + w for k, w in zip(batch.column("keys").to_pylist(), batch.column("words").to_pylist(), strict=True)] if "words" in batch.schema.names else None
            root = batch.column("root").to_numpy() if words else None
            out = []
            for s, a, b in touched:
                i = owner[a:b]
                # a class's keys and words go to a shard once, whatever the number of its keys there
                once = zip(*np.unique(ids[i], return_index=True), strict=True) if words else ()
                large = b"".join(int(c).to_bytes(8, "little", signed=True) + len(words[i[k]]).to_bytes(4, "little") + words[i[k]] for c, k in once)
                out.append((s, keys[a:b].tobytes(), ids[i].tobytes(), n[i].astype(np.int32).tobytes(), sig[ranges(s_at[i], size[i])].tobytes(), root[i].tobytes() if words else b"", large))
            yield from _table(out, _KEYED).to_batches()

    return rows.where("octet_length(keys) > 0").mapInArrow(send, _KEYED_DDL).groupBy("shard")


def _matrices(order: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Groups order[at[i] : at[i] + count[i]] of two and more as index matrices of like sizes (-1: nothing)."""
    steps = [2]
    while steps[-1] < (count.max() if len(count) else 0):
        steps.append(max(steps[-1] + 1, steps[-1] * 9 // 8))
    padded = np.array(steps)[np.searchsorted(steps, np.maximum(count, 2))] if len(count) else count
    out = []
    for size in np.unique(padded[count > 1]):
        rows_ = np.flatnonzero((padded == size) & (count > 1))
        for a in range(0, len(rows_), max(1, (1 << 16) // int(size))):
            r = rows_[a : a + max(1, (1 << 16) // int(size))]
            column = np.arange(size)
            idx = order[np.minimum(at[r][:, None] + column, len(order) - 1)]
            out.append(np.where(column < count[r][:, None], idx, -1))
    return out


def _buckets(rows: pa.Table, least: float) -> tuple[Signatures, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Signatures, ids and components (if sent) of a shard's classes, and its buckets as index matrices of like sizes (-1: nothing)."""
    key, ids, n, sig = (_stream(rows.column(c), t) for c, t in (("key", np.uint64), ("id", np.int64), ("n", np.int32), ("sig", np.uint64)))
    root = _stream(rows.column("root"), np.int64)
    sigs = Signatures(sig, n, least)
    order = np.lexsort((ids, key))
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    return sigs, ids, root, _matrices(order, at, count)


def _around_pivots(sigs: Signatures, b: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Links that stand for all possible pairs of the crowds in a bucket, and which members are in no crowd: their pairs among themselves are left.

    A crowd is a pivot and what is so near to it that they are alike, most likely; its members are linked to the
    pivot and not compared.  Others are compared with a crowd until they have such a link, or one of any kind and
    ``NEARBY`` members are tried.  What is too far from the pivot is too far from all of the crowd.
    """
    rest, found, crowds, n = np.arange(len(b)), [], [], sigs.n[b]
    while len(rest) > LARGE:
        x, y = b[rest[np.linspace(0, len(rest) - 1, PIVOTS).astype(np.int64)]][:, None], b[rest][None]
        w = sigs.weight(x, y)
        near = w <= sigs.limit(sigs.n[x], sigs.n[y]) // 2
        free = np.ones(len(rest), bool)
        for k in np.argsort(-near.sum(1), kind="stable"):
            mine = np.flatnonzero(near[k] & free)
            if len(mine) >= CROWD:
                free[mine] = False
                crowds.append((x[k, 0], rest[mine], w[k, mine]))
        taken = len(rest) - int(free.sum())
        rest = rest[free]
        if taken < max(CROWD, (len(rest) + taken) // 8):
            break
    open_ = np.ones(len(b), bool)
    for pivot, members, radius in crowds:
        own = b[members] != pivot
        found.append((np.full(own.sum(), pivot), b[members[own]], radius[own]))
        open_[members] = False
        y = np.flatnonzero(open_)
        far = sigs.distance(np.full(len(y), pivot), b[y]) - radius.max()
        # a pivot's coarser signature says nothing of what a member's still coarser one shows
        sound = sigs.tier[b[members]].min() >= np.minimum(sigs.tier[pivot], sigs.tier[b[y]])
        y = y[~sound | (far <= 2 * (np.maximum(n[y], n[members].max()) * (1 - sigs.least) + 1e-9).astype(np.int64))]
        members = members[np.argsort(radius, kind="stable")]
        best, link = np.full(len(y), _NONE, np.int64), np.zeros(len(y), np.int64)
        left, lo, many = np.arange(len(y)), 0, NEARBY // 4
        while lo < len(members) and len(left):
            some = members[lo : lo + min(many, max(1, (1 << 18) // len(left)))]
            w = sigs.weight(b[some][:, None], b[y[left]][None])
            first = w.argmin(0)
            w = w[first, np.arange(len(left))]
            better = np.flatnonzero(w < best[left])
            best[left[better]], link[left[better]] = w[better], b[some[first[better]]]
            lo, many = lo + len(some), many * 2
            done = best[left] <= sigs.limit(sigs.n[link[left]], n[y[left]]) // 2
            left = left[~(done | (best[left] < _NONE) & (lo >= NEARBY))]
        linked = best < _NONE
        found.append((link[linked], b[y[linked]], best[linked]))
    alone = np.zeros(len(b), bool)
    alone[rest] = True
    return found, alone


def spanning_forest(sigs: Signatures, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of each row's possible pairs, light ones first, and their weights, all rows at once.

    Members are compared with those of a row that are longer, but not by too much: others can't be alike.
    """
    row, place = np.nonzero(idx >= 0)
    member = idx[row, place]
    order = np.lexsort((sigs.n[member], row))
    row, member = row[order], member[order]
    found, held = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)], 0
    if idx.shape[1] > LARGE:
        first, alone = np.searchsorted(row, np.arange(len(idx) + 1)), np.ones(len(row), bool)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            links, alone[lo:hi] = _around_pivots(sigs, member[lo:hi])
            found += links
        row, member = row[alone], member[alone]
    n = sigs.n[member].astype(np.int64)
    at = np.arange(len(member))
    many = np.searchsorted(row << 32 | n, row << 32 | ((n + 1e-6) / sigs.least).astype(np.int64), "right") - at - 1
    total = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(member):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 17), "right")) - 1)
        i, j = np.repeat(member[lo:hi], many[lo:hi]), member[ranges(at[lo:hi] + 1, many[lo:hi])]
        w = sigs.weight(i, j)
        possible = np.flatnonzero(w < _NONE)
        found.append((i[possible], j[possible], w[possible]))
        held, lo = held + len(possible), hi
        if held > 1 << 19:
            found, held = [_thinned(found)], 0
    return _thinned(found)


def _thinned(links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all links, a least spanning forest."""
    a, b, w = (np.concatenate(c) for c in zip(*links, strict=True))
    kept = lightest(a, b, w)
    return a[kept], b[kept], w[kept]


def lightest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which links are a least spanning forest of all of them (Boruvka's way): as many as there are nodes, at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, w))
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    root, left, kept = np.arange(len(nodes)), np.arange(len(order)), [np.zeros(0, np.int64)]
    while len(left):
        p, q = root[x[left]], root[y[left]]
        left, p, q = (v[p != q] for v in (left, p, q))
        # each component's first link, in that order, is in the forest
        best = np.full((2, len(nodes)), len(order))
        best[0, p[::-1]], best[1, q[::-1]] = left[::-1], left[::-1]
        best = best.min(0)
        chosen = np.unique(best[best < len(order)])
        kept.append(chosen)
        root = joined_roots(root, x[chosen], y[chosen])
    return order[np.sort(np.concatenate(kept))]


def forest(links: DataFrame, piece: int = 1 << 19) -> DataFrame:
    """(a, b) of links (a, b, w): of what buckets found, in pieces, a least spanning forest.

    Copies share many buckets, each with links of its own; one forest stands for them all.  If one of its links fails,
    the components that it would have joined are searched again, as those of any failed link.
    """
    links = cut(links)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a, b, w = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b", "w"))
            i = lightest(a, b, w)
            return pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[i])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= piece:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return links.coalesce(max(1, -(-links.count() // piece))).mapInArrow(thin, "a long, b long")


def near_links(rows: DataFrame, shards: int, least: float) -> DataFrame:
    """(a, b, w), a < b: a spanning forest of each bucket's possible pairs, with what they are apart at least. rows: id, n, sig, keys."""

    def link(rows: pa.Table) -> pa.Table:
        sigs, ids, _, buckets = _buckets(rows, least)
        found = [np.zeros((0, 3), np.int64)]
        for idx in buckets:
            i, j, w = spanning_forest(sigs, idx)
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), w], 1))
        links = np.concatenate(found)
        links = links[lightest(*links.T)]
        tidy()
        return pa.table({"a": links[:, 0].copy(), "b": links[:, 1].copy(), "w": links[:, 2].astype(np.int32)})

    return _dealt(rows.select("id", "n", "sig", "keys"), shards).applyInArrow(link, "a long, b long, w int")


def _unpacked(blobs: list[bytes]) -> dict[int, bytes]:
    """What was sent once of each id: 8 bytes of it, 4 of a length, and so many bytes."""
    out: dict[int, bytes] = {}
    for data in blobs:
        at = 0
        while at < len(data):
            c, size = int.from_bytes(data[at : at + 8], "little", signed=True), int.from_bytes(data[at + 8 : at + 12], "little")
            out[c] = data[at + 12 : at + 12 + size]
            at += 12 + size
    return out


class Wide:
    """Large signatures of a shard's classes, one for each id; ``of`` is the row of each entry."""

    def __init__(self, blobs: list[bytes] | dict[int, bytes], ids: np.ndarray) -> None:
        cells = blobs if isinstance(blobs, dict) else _unpacked(blobs)
        known = np.array(sorted(cells), np.int64)
        self.planes = tuple(np.zeros((len(known), WIDE // 64), np.uint64) for _ in range(2))
        listed = [np.sort(np.frombuffer(cells[c], np.uint16)) for c in known.tolist()]
        #: cells of every class in order, one after another, and where each begins
        self.cells, self.first = np.concatenate([np.zeros(0, np.uint16), *listed]), np.cumsum([0, *map(len, listed)])
        for i, own in enumerate(listed):
            counts = np.bincount(own, minlength=WIDE)
            for k, plane in enumerate(self.planes):
                plane[i] = np.packbits((counts >> k & 1).astype(np.uint8), bitorder="little").view(np.uint64)
        self.of = np.searchsorted(known, ids)

    def finer(self, members: np.ndarray, least: float) -> list[np.ndarray]:
        """Groups of a bucket's members that hold every pair which can be alike.

        Like sequences of n and m words share all but a fifth of the longer one's (at 0.8), so that of the cells of
        either, in order of their rarity in the bucket, the first fifth and one more hold one of the other's.
        Repeats of a cell count as cells of their own.
        """
        row = self.of[members]
        size = self.first[row + 1] - self.first[row]
        owner = np.repeat(np.arange(len(members)), size)
        cell = self.cells[ranges(self.first[row], size)].astype(np.int64)
        new = np.append(True, (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1]))[: len(cell)]
        run = np.flatnonzero(new)
        cell = cell << 32 | (np.arange(len(cell)) - run[np.cumsum(new) - 1])
        _, name, often = np.unique(cell, return_inverse=True, return_counts=True)
        order = np.lexsort((name, often[name], owner))
        rank = np.arange(len(order)) - (np.cumsum(size) - size)[owner]  # owners keep their places
        kept = order[rank <= (size * (1 - least) + 1e-9).astype(np.int64)[owner]]
        kept = kept[np.argsort(name[kept], kind="stable")]
        at = np.flatnonzero(np.append(True, np.diff(name[kept]) != 0))[: len(kept)]
        return _matrices(members[owner[kept]], at, np.diff(np.append(at, len(kept))))


def _narrowed(w: np.ndarray, x: np.ndarray, y: np.ndarray, sigs: Signatures, wide: Wide) -> None:
    """Sets weights to _NONE where wide signatures exclude a pair, and to their more exact count elsewhere."""
    where = np.nonzero(w < _NONE)
    i, j = (np.broadcast_to(v, w.shape)[where] for v in (x, y))
    n, m = sigs.n[i], sigs.n[j]
    limit = 2 * (np.maximum(n, m) * (1 - sigs.least) + 1e-9).astype(np.int32) - np.abs(n - m)
    d = np.concatenate([np.zeros(0, np.int32), *(_apart(wide.planes, wide.of[i[a : a + 4096]], wide.planes, wide.of[j[a : a + 4096]]) for a in range(0, len(i), 4096))])
    w[where] = np.where(d <= limit, d, _NONE)


def cells_of(words: list[np.ndarray]) -> list[np.ndarray]:
    """The cells, of ``WIDE``, that each sequence's words are counted in, as ``signatures`` counts them, in order; many sequences at once."""
    size, out, lo = np.array([len(x) for x in words], np.int64), [], 0
    total = np.concatenate([[0], np.cumsum(size)])
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 19), "right")) - 1)
        owner = np.repeat(np.arange(hi - lo, dtype=np.uint64) << _U(32), size[lo:hi])
        both = np.sort(owner | np.concatenate(words[lo:hi]).astype(np.uint64))
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        nth = np.arange(len(both)) - np.repeat(at, np.diff(np.append(at, len(both))))
        cell = mix((both & _U(0xFFFFFFFF)) + _U(5) + (nth // 3).astype(np.uint64) * _U(0xE7037ED1A0B428DB)) & _U(WIDE - 1)
        cells = (np.sort(owner | cell) & _U(WIDE - 1)).astype(np.uint16)  # owners keep their places
        out += np.split(cells, (total[lo + 1 : hi] - total[lo]))
        lo = hi
    return out


def wide_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, wide of sequences (id, words): so many cells that few words meet in one."""
    for batch in batches:
        cells = cells_of([np.frombuffer(x.as_py(), np.uint32) for x in batch.column("words")])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in cells], pa.binary())], ["id", "wide"])


class Joined:
    """Components of a shard's classes while links are found."""

    def __init__(self, root: np.ndarray) -> None:
        known, self.of = np.unique(root, return_inverse=True)
        self.top = np.arange(len(known))

    def label(self, i: np.ndarray) -> np.ndarray:
        return self.top[self.of[i]]

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the links join what was apart, one after another."""
        new = np.zeros(len(i), bool)
        root = self.top.tolist()
        for k, (p, q) in enumerate(zip(self.label(i).tolist(), self.label(j).tolist(), strict=True)):
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)], new[k] = min(p, q), True
        self.top = np.array(root, np.int64)
        while (self.top != (higher := self.top[self.top])).any():
            self.top = higher
        return new


class Turn:
    """Of the keys that a pair shares, which one's bucket is to align it: a hash of the pair says, so that each pair has one turn."""

    def __init__(self, members: np.ndarray, own: int, keys: dict[int, np.ndarray], ids: np.ndarray) -> None:
        self.ids, self.members = ids, np.sort(members)
        many = np.array([len(keys[i]) for i in self.members])
        known, column, often = np.unique(np.concatenate([keys[i] for i in self.members]), return_inverse=True, return_counts=True)
        #: a cell of a hot bucket is no key of its members, and aligns all that it holds
        self.whole = own not in known
        shared = often > 1
        place = np.cumsum(shared) - 1
        size = -(-max(1, int(shared.sum())) // 64) * 64
        bits = np.zeros((len(members), size), np.uint8)
        kept = shared[column]
        bits[np.repeat(np.arange(len(members)), many)[kept], place[column[kept]]] = 1
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        less = np.zeros((1, size), np.uint8)
        less[0, : int((shared & (known < _U(own))).sum())] = 1
        self.less = np.packbits(less, axis=1, bitorder="little").view(np.uint64)

    def here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of entries have their turn."""
        out = np.ones(len(i), bool)
        for a in range(0, 0 if self.whole else len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            both = self.bits[np.searchsorted(self.members, x)] & self.bits[np.searchsorted(self.members, y)]
            shared, less = (np.bitwise_count(v).sum(1, dtype=np.uint64) for v in (both, both & self.less))
            one, two = self.ids[x], self.ids[y]
            number = mix(mix(np.minimum(one, two).view(np.uint64)) + np.maximum(one, two).view(np.uint64))
            out[a : a + (1 << 16)] = number % shared == less
        return out


class Turns:
    """``Turn`` for pairs of any classes of a shard, of which each has few keys."""

    def __init__(self, keys: list[np.ndarray], ids: np.ndarray) -> None:
        self.ids = ids
        self.known, rank = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        #: keys of every class in order, one after another, each with its class, and where those of a class begin
        self.held = np.unique(np.repeat(np.arange(len(keys)), [len(k) for k in keys]) * len(self.known) + rank)
        self.first = np.searchsorted(self.held, np.arange(len(keys) + 1) * len(self.known))

    def here(self, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which pairs of classes have their turn in the buckets ``own``."""
        out = np.ones(len(i), bool)
        for a in range(0, len(i), 1 << 12):
            x, y, bucket = i[a : a + (1 << 12)], j[a : a + (1 << 12)], own[a : a + (1 << 12)]
            many = self.first[x + 1] - self.first[x]
            pair, rank = np.repeat(np.arange(len(x)), many), self.held[ranges(self.first[x], many)] % len(self.known)
            wanted = y[pair] * len(self.known) + rank
            both = self.held[np.minimum(np.searchsorted(self.held, wanted), len(self.held) - 1)] == wanted
            pair, key = pair[both], self.known[rank[both]]
            shared, less, named = (np.bincount(pair[v], minlength=len(x)).astype(np.uint64) for v in (slice(None), key < bucket[pair], key == bucket[pair]))
            one, two = self.ids[x], self.ids[y]
            number = mix(mix(np.minimum(one, two).view(np.uint64)) + np.maximum(one, two).view(np.uint64))
            # a cell of a hot bucket is no key of its members, and aligns all that it holds
            out[a : a + (1 << 12)] = (named == 0) | (number % np.maximum(shared, _U(1)) == less)
        return out


def untried_links(rows: DataFrame, shards: int, least: float) -> DataFrame:
    """(a, b), a < b: like pairs of members of different components, as many as join all components that a bucket's like pairs join.

    rows: id, n, sig, keys, root (the component), words (packed uint32).  Every possible pair of a bucket whose ends are
    still apart is aligned, the most similar first; of buckets that share it, by one (``Turn``, ``Turns``).
    """

    def link(rows: pa.Table) -> pa.Table:
        sigs, ids, root, buckets = _buckets(rows, least)
        key, words = _stream(rows.column("key"), np.uint64), _unpacked(rows.column("words").to_pylist())
        split = {c: 4 + int.from_bytes(x[:4], "little") for c, x in words.items()}
        keys_of = [np.frombuffer(words[c][4 : split[c]], np.uint64) & _U((1 << KEY_BITS) - 1) for c in sorted(words)]
        words = {c: x[split[c] :] for c, x in words.items()}
        sequence = [np.frombuffer(words[c], np.uint32) for c in sorted(words)]
        wide, joined = Wide({c: x.tobytes() for c, x in zip(sorted(words), cells_of(sequence), strict=True)}, ids), Joined(root)
        turns = Turns(keys_of, np.array(sorted(words), np.int64))
        classes_, found, tried = len(sequence), [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
        entry = np.zeros(classes_, np.int64)
        entry[wide.of] = np.arange(len(ids))  # one of the entries of each class
        small, large = [x for x in buckets if x.shape[1] <= LARGE], [x for x in buckets if x.shape[1] > LARGE]

        def finer() -> Iterator[tuple[np.ndarray, Turn]]:
            for bucket in (row[row >= 0] for x in large for row in x):
                own_keys = dict(zip(bucket.tolist(), (keys_of[c] for c in wide.of[bucket].tolist()), strict=True))
                turn = Turn(bucket, int(key[bucket[0]]), own_keys, ids)
                yield from ((part, turn) for part in wide.finer(bucket, least))

        for idx, turn in chain(((x, None) for x in small), finer()):
            size = idx.shape[1]
            own = joined.label(np.where(idx < 0, idx[:, :1], idx))
            # a pair across components has an end outside the bucket's usual one, so that only such members need lists
            usual = np.sort(own, 1)[:, size // 2]
            bucket, place = np.nonzero((own != usual[:, None]) & (idx >= 0))
            step = max(1, (1 << 20) // size)
            for at in range(0, len(bucket), step):
                x, y = idx[bucket[at : at + step], place[at : at + step]][:, None], idx[bucket[at : at + step]]
                safe = np.maximum(y, 0)
                w = sigs.weight(x, safe)
                w[(y < 0) | (joined.label(x) == joined.label(safe))] = _NONE
                _narrowed(w, x, safe, sigs, wide)
                where = np.nonzero(w < _NONE)
                i, j = (np.broadcast_to(v, w.shape)[where] for v in (x, safe))
                mine = turn.here(i, j) if turn else turns.here(wide.of[i], wide.of[j], key[i])
                i, j, where = i[mine], j[mine], tuple(v[mine] for v in where)
                i, j = wide.of[i], wide.of[j]
                pair, once = np.unique(np.minimum(i, j) * classes_ + np.maximum(i, j), return_index=True)
                fresh = ~np.isin(pair, tried)
                pair, weight = pair[fresh], w[where][once][fresh]
                pair, lo, many = pair[np.argsort(weight, kind="stable")], 0, FIRST
                while lo < len(pair):
                    i, j = np.divmod(pair[lo : lo + many], classes_)
                    lo, many = lo + many, min(MOST, many * MORE)
                    apart = joined.label(entry[i]) != joined.label(entry[j])
                    i, j = i[apart], j[apart]
                    both = [(sequence[p], sequence[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
                    ok = within(both, np.array([int(max(len(p), len(q)) * (1 - least) + 1e-9) for p, q in both]))
                    tried = np.append(tried, i[~ok] * classes_ + j[~ok])
                    i, j = i[ok], j[ok]
                    new = joined.join(entry[i], entry[j])
                    ends = ids[entry[i[new]]], ids[entry[j[new]]]
                    found.append(np.stack([np.minimum(*ends), np.maximum(*ends)], 1))
        pairs = np.concatenate(found)
        tidy()
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return _dealt(rows.select("id", "n", "sig", "keys", "root", "words"), shards).applyInArrow(link, "a long, b long")


# ---------------------------------------------------------------- alignment


def alignment_distance(a: bytes | np.ndarray, b: bytes | np.ndarray, most: int) -> int:
    """Word edit distance of two sequences of uint32 word identities, or most + 1 if it is larger."""
    a, b = (np.frombuffer(v, np.uint32) if isinstance(v, bytes) else v for v in (a, b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = _trimmed(a, b)
    if len(a) == 0:
        return len(b) if len(b) <= most else most + 1
    band = min(most, max(8, len(b) - len(a)))
    pattern, text = a.tolist(), b.tolist()
    masks: dict[int, int] = {}
    for i, v in enumerate(pattern):
        masks[v] = masks.get(v, 0) | 1 << i
    while True:
        d = _banded(masks, len(pattern), text, band)
        if d <= band or band >= most:
            return d if d <= most else most + 1
        band = min(most, 2 * band)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences without what they share at either end, the shorter one first."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return (b, a) if len(a) > len(b) else (a, b)


def _one_shift(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of the best alignment (a is not longer) that inserts words in one place alone: never fewer than the distance."""
    more = len(b) - len(a)
    straight, shifted = np.cumsum(a != b[: len(a)]), np.cumsum(a != b[more:])
    return min(int(shifted[-1]), int((straight - shifted).min() + shifted[-1])) + more


def _banded(masks: dict[int, int], m: int, text: list[int], k: int) -> int:
    """Edit distance through cells at most ``k`` off the diagonal; exact if it is at most ``k``.

    Vertical differences of the rows j - k to j + k of column j are two integers;
    bit 0 is row j - k.  The score follows the window's last row down to row m,
    and then row m along the text.  A band beyond the pattern is the whole of it.
    """
    if k >= m:
        plus, minus, full, score = (1 << m) - 1, 0, (1 << m) - 1, m
        for v in text:
            x = masks.get(v, 0)
            d0 = (((x & plus) + plus) ^ plus) | x | minus
            hp = (minus | ~(d0 | plus)) & full
            hn = plus & d0
            score += (hp >> (m - 1) & 1) - (hn >> (m - 1) & 1)
            hp = (hp << 1 | 1) & full
            plus = ((hn << 1) | ~(d0 | hp)) & full
            minus = d0 & hp
        return score
    size = 2 * k + 1
    full = (1 << size) - 1
    plus, minus, score, shift = full >> k << k, 0, k, -k
    for j, v in enumerate(text, 1):
        x = masks.get(v, 0)
        x = (x >> shift if shift >= 0 else x << -shift) & full
        d0 = ((((x & plus) + plus) ^ plus) | x | minus) & full
        hp = minus | ~(d0 | plus) & full
        hn = d0 & plus
        beyond = j - (m - k)
        if beyond <= 0:
            score += 1 - (d0 >> (size - 1) & 1)
        else:
            score += (hp >> (size - 1 - beyond) & 1) - (hn >> (size - 1 - beyond) & 1)
        plus = hn | ~(d0 >> 1 | hp) & full
        minus = d0 >> 1 & hp
        shift += 1
    return score


#: Bands beyond this width are aligned one pair at a time, in long integers.
_WIDEST = 96


def _banded_many(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Edit distances of pairs (shorter, longer) through cells at most ``k`` off the diagonal, row by row for all pairs at once; exact where at most ``k``."""
    order = np.argsort([-len(a) for a, _ in pairs], kind="stable")
    la, lb = np.array([len(pairs[i][0]) for i in order]), np.array([len(pairs[i][1]) for i in order])
    high, size = int(la[0]), 2 * k + 1
    a = np.zeros((len(order), high), np.uint32)
    b = np.zeros((len(order), high + size), np.uint32)  # cells beyond either end never count
    for r, i in enumerate(order):
        x, y = pairs[i]
        a[r, : len(x)] = x
        y = y[: high + k]
        b[r, k : k + len(y)] = y
    step = np.arange(size, dtype=np.int16)
    far = np.int16(1 << 12)
    row = np.where(step >= k, step - k, far).astype(np.int16)[None].repeat(len(order), 0)
    out = np.full(len(order), k + 1, np.int64)
    for i in range(1, high + 1):
        live = int(np.searchsorted(-la, -i, "right"))
        row = row[:live]
        cost = row + (b[:live, i - 1 : i - 1 + size] != a[:live, i - 1 : i])
        cost[:, :-1] = np.minimum(cost[:, :-1], row[:, 1:] + 1)
        if i <= k:
            cost[:, : k - i] = far
            cost[:, k - i] = i
        row = np.minimum.accumulate(cost - step, 1) + step
        last = np.flatnonzero(la[:live] == i)
        where = lb[last] - i + k
        fits = where < size
        out[last[fits]] = row[last[fits], where[fits]]
    back = np.empty(len(order), np.int64)
    back[order] = np.minimum(out, k + 1)
    return back


def within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of uint32 sequences is at most ``most`` of it."""
    good = np.zeros(len(pairs), bool)
    if not pairs:
        return good
    sizes = np.array([[len(x), len(y)] for x, y in pairs])
    # words that one has more often than the other need an edit each
    left = np.concatenate([x for x, _ in pairs]).astype(np.uint64) | np.repeat(np.arange(len(pairs), dtype=np.uint64) << _U(32), sizes[:, 0])
    right = np.concatenate([y for _, y in pairs]).astype(np.uint64) | np.repeat(np.arange(len(pairs), dtype=np.uint64) << _U(32), sizes[:, 1])
    word = np.concatenate([left, right])
    order = np.argsort(word, kind="stable")
    word, sign = word[order], np.concatenate([np.ones(len(left), np.int64), -np.ones(len(right), np.int64)])[order]
    at = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
    if len(at):
        surplus, pair = np.add.reduceat(sign, at), (word[at] >> _U(32)).astype(np.int64)
        over = np.maximum(np.bincount(pair, np.maximum(surplus, 0), len(pairs)), np.bincount(pair, np.maximum(-surplus, 0), len(pairs)))
    else:
        over = np.zeros(len(pairs))
    rest, narrow = {}, {}
    for i in np.flatnonzero((over <= most) & (np.abs(sizes[:, 0] - sizes[:, 1]) <= most)).tolist():
        a, b = _trimmed(*pairs[i])
        if len(a) == 0 or len(b) <= most[i]:
            good[i] = len(b) <= most[i]
        elif _one_shift(a, b) <= most[i]:
            good[i] = True
        elif most[i] > _WIDEST:
            good[i] = alignment_distance(a, b, int(most[i])) <= most[i]
        else:
            rest[i] = (a, b)
    # a narrow band first; what doesn't fit, in its whole band
    for whole in (False, True):
        groups: dict[int, list[int]] = {}
        for i, (a, b) in rest.items():
            k = int(most[i]) if whole else min(int(most[i]), max(8, len(b) - len(a)))
            groups.setdefault(min(_WIDEST, -(-k // 8) * 8), []).append(i)
        narrow = {}
        for k, members in groups.items():
            members.sort(key=lambda i: len(rest[i][0]))
            chunk = max(16, (1 << 17) // (2 * k + 1))
            for a in range(0, len(members), chunk):
                part = members[a : a + chunk]
                d = _banded_many([rest[i] for i in part], k)
                for i, x in zip(part, d.tolist(), strict=True):
                    if x <= k:
                        good[i] = x <= most[i]
                    elif k < most[i]:
                        narrow[i] = rest[i]
        rest = narrow
        if not rest:
            break
    return good


def aligned(pairs: DataFrame, n: int, fetch: Callable[[DataFrame, int], DataFrame], least: float) -> DataFrame:
    """a, b, ok of ``n`` pairs (a, b).  ``fetch`` gives block, id, words (packed uint32) of (id, block) rows.

    Pairs are dealt into blocks by both ends, so that a sequence of many pairs travels
    once per block and not once per pair.
    """
    side = max(1, round((n / 4000) ** 0.5))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    pairs = pairs.select("a", "b", (part("a") * side + part("b")).cast("int").alias("block"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "block"), F.struct(F.col("b").alias("id"), "block"))).alias("e")).select("e.*").distinct()
    result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result.empty_table()
        ids, order = np.unique(right.column("id").to_numpy(), return_index=True)  # identical rows give a sequence twice
        words = right.column("words").combine_chunks()
        words = [np.frombuffer(words[int(i)].as_buffer(), np.uint32) if len(words[int(i)].as_buffer()) else np.zeros(0, np.uint32) for i in order]
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        x, y, ok = np.searchsorted(ids, a), np.searchsorted(ids, b), []
        for lo in range(0, len(a), 2000):
            part = [(words[i], words[j]) for i, j in zip(x[lo : lo + 2000].tolist(), y[lo : lo + 2000].tolist(), strict=True)]
            ok.append(within(part, np.array([int(max(len(p), len(q)) * (1 - least) + 1e-9) for p, q in part])))
        tidy()
        return pa.table([pa.array(a), pa.array(b), pa.array(np.concatenate(ok))], schema=result)

    found = fetch(ends, n).select("block", "id", "words")
    return pairs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(judge, "a long, b long, ok boolean")


# ---------------------------------------------------------------- all together


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def like_components(rows: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], least: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every class that is like another: components of the like pairs within buckets.

    rows: id, n, sig, keys, written already.  ``fetch``: see ``aligned``.  known: links (a, b) that hold anyway.
    """
    entries = int(rows.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    shards = max(min(width(rows.sparkSession), max(SHARDS, entries >> 16)), -(-entries // (1 << 18)))

    def tried(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        n = pairs.count()
        return cut(aligned(pairs, n, fetch, least)) if n else pairs.withColumn("ok", F.lit(False))

    seen = tried(forest(near_links(rows, shards, least)))
    good = seen.where("ok").select("a", "b")
    if known is not None:
        good = good.unionByName(known)
    found = components(good)
    bad = seen.where("NOT ok")
    if not bad.limit(1).count():
        return found
    rooted = rows.where("octet_length(keys) > 0").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "sig", "keys", F.coalesce("root", "id").alias("root"))
    ends = bad.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    doubtful = cut(rooted.join(rooted.join(ends, "id").select("root").distinct(), "root", "left_semi"))
    # in a bucket of these few classes, pairs are aligned where they meet
    n = doubtful.count()
    few_each = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4000))).cast("int").alias("block")
    words = fetch(doubtful.select("id", few_each), n).select("id", "words").dropDuplicates(["id"])
    doubtful = stored(doubtful.join(words, "id"), "doubtful")
    entries = int(doubtful.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    shards = max(width(rows.sparkSession), -(-entries // (1 << 15)))
    return components(good.unionByName(untried_links(doubtful, shards, least)))
