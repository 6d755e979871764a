"""Shared pieces of the training-data operators.

Three things live here: how tables are read, where lineage is cut, and the
vectorised byte-level text machinery (word boundaries, 64-bit word identities,
hashes of word windows) that several operators build on.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Shuffle width that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (tests on one machine) a temporary folder stands in.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lodeseam-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage.

    The files survive the loss of any executor and go when the plan that reads
    them is garbage collected (``cleanCheckpoints``) or the folder is cleared.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, *cols: str) -> int:
    """Bytes of UTF-8 in the columns, counted over every row."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in cols), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


# ---------------------------------------------------------------- Arrow


def binary_parts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- hashing

_U = np.uint64
_BASE, _WBASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


#: Long inputs are hashed in pieces of so many positions, so that power tables stay small.
_PIECE = 1 << 18
_WORDS = _Powers(_WBASE)
#: The lowest k bytes of eight, by k.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG_WORD = 256


def _classes(members: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in members:
        out[lo : hi + 1] = True
    return out


#: Anything but ASCII white space.
NOT_SPACE = ~_classes([(0x09, 0x0D), (0x20, 0x20)])
#: ASCII letters and digits, and every byte of other characters.
ALNUM = _classes([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Word boundaries and identities of a batch of texts.

    start, end: byte range of each word in the batch's bytes; doc: index of its
    text; first: index of each text's first word (one more entry at the end).
    """

    def __init__(self, column, classes: np.ndarray, lower: bool = False) -> None:
        raw, offsets = binary_parts(column)
        n = len(offsets) - 1
        self.raw = raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = classes[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.counts)

    def ids(self) -> np.ndarray:
        """64-bit identity of each word's bytes.

        A word is read eight bytes at a time; each piece is mixed with its place,
        and the sum of the pieces is mixed with the length.  Words of up to eight
        bytes and equal length therefore never share an identity; beyond
        ``_LONG_WORD`` bytes a word is digested as a whole.
        """
        start, size = self.start, self.end - self.start
        raw = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        out = mix(eight[start] & _LOW_BYTES[np.minimum(size, 8)])
        rows = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        at = 8
        while len(rows):
            left = size[rows] - at
            out[rows] += mix((eight[start[rows] + at] & _LOW_BYTES[np.minimum(left, 8)]) + _U(at * _BASE & 0xFFFFFFFFFFFFFFFF))
            rows, at = rows[left > 8], at + 8
        for i in np.flatnonzero(size > _LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.raw[start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(out + size.astype(np.uint64))


def run_digest(ids: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit digest of each run [first[i], first[i + 1]) of word identities: the sum of its words, each mixed with its place."""
    n = np.diff(first)
    place = np.arange(first[-1] - first[0], dtype=np.uint64) - np.repeat((first[:-1] - first[0]).astype(np.uint64), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids[first[0] : first[-1]] + mix(place + _U(salt))))])
    return mix(total[first[1:] - first[0]] - total[first[:-1] - first[0]] + n.astype(np.uint64) * _U(salt | 1))


def window_hash(ids: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` word identities (len - size + 1 of them)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values = mix(ids + _U(salt)) if salt else ids
    out = np.empty(n, np.uint64)
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        part = values[a : b + size - 1]
        up, down = _WORDS.get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        out[a:b] = (total[size : size + b - a] - total[: b - a]) * down[: b - a]
    return mix(out)


# ---------------------------------------------------------------- compact integers


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as gaps of the least width, high and low bytes apart."""
    n = len(values)
    if n == 0:
        return b""
    v = values.astype(np.int64)
    gaps = np.empty(n, np.uint64)
    gaps[0] = 0
    gaps[1:] = (v[1:] - v[:-1]).astype(np.uint64)
    most = int(gaps.max())
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = gaps.view(np.uint8).reshape(n, 8)[:, :size].T.copy()
    low, high = planes[0].tobytes(), planes[1:].tobytes()
    return n.to_bytes(4, "little") + bytes([size]) + int(v[0]).to_bytes(8, "little", signed=True) + low + (zlib.compress(high, 1) if high else b"")


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n, size = int.from_bytes(data[:4], "little"), data[4]
    first = int.from_bytes(data[5:13], "little", signed=True)
    planes = np.zeros((8, n), np.uint8)
    planes[0] = np.frombuffer(data, np.uint8, n, 13)
    if size > 1:
        planes[1:size] = np.frombuffer(zlib.decompress(data[13 + n :]), np.uint8).reshape(size - 1, n)
    gaps = planes.T.copy().view(np.uint64)[:, 0]
    return np.cumsum(gaps.astype(np.int64)) + first


def tidy() -> None:
    """Gives freed work memory back to the system: workers are reused, and one executor runs several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """A batch in runs of rows whose texts hold about ``most`` bytes (at least one row), so that work arrays stay small."""
    _, offsets = binary_parts(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    tidy()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift
