"""WARC archives: one gzip member per record, written and read in parallel.

Writing: every partition streams its records to one archive in the shared
folder under a name of its own attempt; the manifest of finished archives is
materialised, so an archive of a lost or repeated attempt is never read.

Reading: one task per archive, one pass, bounded memory: compressed bytes are
fetched in blocks, each gzip member is inflated incrementally, the record is
framed by its Content-Length, its digest is verified, and a partial or damaged
record raises with its archive and offset.

Duplicate payloads: of records whose payloads are equal and have at least
``min_revisit`` bytes, that with the smallest id is a ``response`` and the
others are ``revisit`` records that refer to it and carry only HTTP headers.
Rows that tie for the smallest id are all responses, and so are all records
with a null id whose payload has no other id.  Payloads are compared by SHA-256
and length.

Every archive begins with a warcinfo record; record ids are unique, whatever the page_ids.

Odd input: null payload: empty; null url: empty; null ids are kept as null;
repeated rows give repeated records; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, slices, table

BLOCK = 1 << 20
_EPOCH = "1970-01-01T00:00:00Z"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response).

    Which records revisit which is decided on ids, digests and sizes alone.  Payloads
    join the decision by (digest, page_id), so that the copies of one payload are
    spread over all tasks, and only where some payload has copies.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    names = rows.where(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    first = names.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 AND first_id IS NOT NULL")
    first = cut(first.select(F.col("digest").alias("_f"), "first_id"))
    if not first.limit(1).count():
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    later = names.join(first, F.col("digest") == F.col("_f")).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    later = later.select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), F.col("first_id").cast("long").alias("refers_to")).distinct()
    return rows.join(later, (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def _name(page_id) -> str:
    return "none" if page_id is None else str(page_id)


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, serial: str) -> bytes:
    """The bytes of one record: WARC header, HTTP header, and a response's body.

    ``serial`` tells records of equal page_ids apart; a revisit names the page it
    refers to, and its payload by the digest.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_name(page_id)}:{serial}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{_name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    """An archive's first record, which says what it is."""
    block = f"software: lodeseam\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name[:32]}>", f"WARC-Date: {_EPOCH}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition of ``records``; returns the manifest (archive, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uuid.uuid4().hex}.warc.gz"
        fs, root = _store(folder)
        out, n, size = None, 0, 0

        def add(record: bytes) -> None:
            nonlocal size
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            size += len(member)

        try:
            for batch in (part for whole in batches for part in slices(whole, "payload")):
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
                for i in range(batch.num_rows):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        add(_info(name))
                    page, url, payload, digest, refers_to = (c[i] for c in columns)
                    add(_record(page.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py(), f"{name[:32]}:{n}"))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pylist([{"archive": name, "n_records": n, "n_bytes": size}], pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return cut(records.mapInArrow(write, "archive string, n_records long, n_bytes long"))


class BadRecord(ValueError):
    """A record that is cut off, misframed or fails its digest."""


def _members(stream) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, inflated pieces) of each gzip member of a stream; a member must be read before the next is asked for."""
    held, at = b"", 0

    def inflate() -> Iterator[bytes]:
        nonlocal held, at
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            if not held:
                held = stream.read(BLOCK)
                if not held:
                    raise BadRecord("the stream ends inside a gzip member")
            before = len(held)
            piece = inflater.decompress(held, BLOCK)
            held = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            at += before - len(held)
            if piece:
                yield piece

    while held or (held := stream.read(BLOCK)):
        yield at, inflate()


def _parse(pieces: Iterator[bytes]) -> dict | None:
    """One record from the inflated pieces of its member, null for a warcinfo; header bytes are buffered, the body is only digested."""
    data = b""
    while b"\r\n\r\n" not in data:
        piece = next(pieces, None)
        if piece is None:
            raise BadRecord("no end of the WARC header")
        data += piece
    head, _, data = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise BadRecord(f"not a WARC header: {lines[0][:40]!r}")
    left, block, body = int(fields["Content-Length"]), hashlib.sha256(), hashlib.sha256()
    http, http_done, body_bytes, tail = b"", False, 0, b""
    while True:
        piece, tail = data[:left], data[left:]
        left -= len(piece)
        block.update(piece)
        if not http_done:
            http += piece
            if b"\r\n\r\n" in http:
                http, _, piece = http.partition(b"\r\n\r\n")
                http_done = True
        if http_done:
            body.update(piece)
            body_bytes += len(piece)
        if left == 0:
            break
        data = next(pieces, None)
        if data is None:
            raise BadRecord(f"the block lacks {left} bytes")
    for piece in pieces:
        tail += piece
    if tail != b"\r\n\r\n":
        raise BadRecord("a record must end with two line breaks and nothing more")
    if fields["WARC-Block-Digest"] != f"sha256:{block.hexdigest()}":
        raise BadRecord("the block's digest differs")
    if fields["WARC-Type"] == "warcinfo":
        return None
    stated = int(next(x.split(b": ", 1)[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (digest != body.hexdigest() or stated != body_bytes):
        raise BadRecord("the payload's digest or length differs")
    name = lambda k: int(v) if (v := fields.get(k, "<urn:page:none>")[len("<urn:page:") : -1].split(":")[0]) != "none" else None
    return {"page_id": name("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": name("WARC-Refers-To")}


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                rows, total = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for at, pieces in _members(stream):
                        try:
                            record = _parse(pieces)
                        except (BadRecord, zlib.error, KeyError, ValueError) as e:
                            raise BadRecord(f"{name} at byte {at}: {e}") from e
                        if record is None:
                            continue
                        rows.append(record)
                        total += 1
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                            rows = []
                if total != expected:
                    raise BadRecord(f"{name}: {total} records; the manifest has {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    spread = manifest.select("archive", "n_records").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(plan_records(table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
