"""Chunking of texts by byte size, at paragraphs and sentences where possible.

Sizes and offsets are UTF-8 bytes.  The rule of a cut, within the next ``size``
bytes: after the last blank line, if that lies beyond a quarter of the size;
else after the last occurrence of the first separator, in a fixed order of
preference, that does; else at the size, moved off the middle of a character.
The next chunk begins ``overlap`` bytes before the cut and at least one byte on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces

# --- fixed values -------------------------------------------------------------
SIZE, OVERLAP = 3000, 200
MOST = 16000
SEPARATORS = (b". ", b".\n", b"? ", b"!\n", b"! ", b"?\n")
# -------------------------------------------------------------------------------


def _on_boundary(data: bytes, at: int, step: int) -> int:
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def _cut(segment: bytes, size: int) -> int:
    least = size // 4
    for mark in (b"\n\n", *SEPARATORS):
        at = segment.rfind(mark)
        if at > least:
            return at + len(mark)
    return len(segment)


def chunk_ranges(data: bytes, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte ranges of the chunks before trimming, blank ones included."""
    if not data.decode().strip():
        return []
    if len(data) <= size:
        return [(0, len(data))]
    out, start = [], 0
    while True:
        end = _on_boundary(data, start + size, -1)
        if end >= len(data):
            return [*out, (start, len(data))] if start < len(data) else out
        stop = start + _cut(data[start:end], size)
        out.append((start, stop))
        start = _on_boundary(data, max(start + 1, stop - overlap), 1)


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, text) of each chunk; texts are trimmed unless the document is one chunk, and cut at MOST bytes."""
    data = text.encode()
    out = []
    for start, end in chunk_ranges(data, size, overlap):
        part = data[start:end].decode()
        part = part if len(data) <= size else part.strip()
        if part:
            raw = part.encode()
            if len(raw) > MOST:
                part = raw[: _on_boundary(raw, MOST, -1)].decode() + "..."
            out.append((start, end, part))
    return out


def chunk_array(texts: pa.Array, size: int = SIZE, overlap: int = OVERLAP) -> pa.Array:
    """The chunks of each text as a list of structs; none of a null."""
    first, found = [0], []
    for text in texts:
        if text.is_valid:
            found += chunks(text.as_py(), size, overlap)
        first.append(len(found))
    start, end, part = zip(*found, strict=True) if found else ((), (), ())
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(part, pa.string())], ["start", "end", "text"]))


def chunk_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<start, end, text>> of each text's chunks."""

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch):
                yield chunk_array(texts, size, overlap)

    return split(text)


def chunk_documents(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``docs``, once per chunk, with chunk_ix, start, end and chunk_text.

    The outer form of the generator, as Catalyst would put a filter on the array's size
    below the plain one, and cut every text a second time for it.
    """
    parts = docs.withColumn("_chunks", chunk_column(F.col(text), size, overlap))
    parts = parts.select(*docs.columns, F.posexplode_outer("_chunks").alias("chunk_ix", "_c")).where("chunk_ix IS NOT NULL")
    return parts.select(*docs.columns, "chunk_ix", F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), F.col("_c.text").alias("chunk_text"))
