"""WARC archives: deduplicated writing as plain files, and a reader that salvages damaged ones.

Writing: equal payloads (by SHA-1) are stored once, in the record of the largest page_id; the other
pages become revisit records that refer to it. Records are text rows of Spark's text writer, whose
line separator completes each record's closing line breaks, so the files are ordinary WARC files
on whatever file system Spark writes to. ``RECORDS_PER_FILE`` bounds a file.

Reading: each file is read by one task. A record is checked (version line, lengths, closing line
breaks, block digest); if a check fails, the reader looks for the next place where a version line
or a gzip member begins, goes on there, and reports the bytes between as a gap with the reason.
Files may be plain or gzipped; a member may hold one record, several, or a whole file, and is salvaged like a
plain file itself: its records carry the member's place, and damage within it is a gap whose reason names the bytes of
the unzipped member. A file is read whole by its task (Spark's binary files, at most 2 GB each).

Odd input: null html counts as empty. Null page_id: the record is a response that nothing refers
to, and its page_id is read as null. Rows that repeat both page_id and payload: all are responses if
that page_id is the largest with this payload, else all revisit it. Payloads under ``min_bytes`` are never revisits. Empty table:
no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_ids, stored

RECORDS_PER_FILE = 2_000
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"(?<=\n)WARC/1\.[01]\r\n|\x1f\x8b\x08")
_NULL_ID = (1 << 127) + (1 << 64)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    """A URN whose number is the page_id (as unsigned 64 bits), so that reading gets it back."""
    return f"<urn:uuid:{uuid.UUID(int=_NULL_ID if page_id is None else page_id & 0xFFFFFFFFFFFFFFFF)}>"


def _page_id(record_id: str | None) -> int | None:
    if not record_id:
        return None
    n = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    return None if n == _NULL_ID else n - (1 << 64) if n >= 1 << 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record up to the first of its two closing line breaks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or 'urn:unknown').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of (page_id, url, html) into WARC files under ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    # who refers to whom is found on digests alone
    digests = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha1"))
    heads = stored(
        digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").select("sha1", "refers_to"),
        "warc-heads",
    )
    revisits = stored(digests.join(heads, "sha1").where("page_id <> refers_to").distinct(), "warc-revisits")
    n = revisits.count()
    marked = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    marked = join_ids(marked, revisits, ["page_id", "sha1"], "left", n)

    def build(batches):
        for batch in batches:
            values, size = [], 0
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                values.append(record(page.as_py(), url.as_py(), payload.as_py().encode(), refers.as_py(), date).decode())
                size += len(values[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": values})
                    values, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})

    lines = marked.select("page_id", "url", "html", "refers_to").mapInArrow(build, "value string")
    lines.write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("errorifexists").text(path)


class _Bad(Exception):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without a colon")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``."""
    unzip = zlib.decompressobj(31)
    try:
        content = unzip.decompress(memoryview(data)[at:]) + unzip.flush()
    except zlib.error as e:
        raise _Bad(f"gzip: {e}") from e
    if not unzip.eof:
        raise _Bad("gzip: member ends early")
    return content, len(data) - len(unzip.unused_data)


def _one(data: bytes, at: int) -> tuple[dict, int]:
    """(record, end) of the record at ``at``, if it passes all checks."""
    if data[at : at + 7] != b"WARC/1.":
        raise _Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise _Bad("headers don't end")
    head = _headers(data[at:stop])
    length = head.get("content-length", "")
    if not length.isdigit():
        raise _Bad("no length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Bad("no line breaks after the block")
    block = data[start:end]
    label, _, value = head.get("warc-block-digest", "").partition(":")
    if label == "sha1" and value != digest(block):
        raise _Bad("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type")
    full = re.search(rb"\r\ncontent-length:\s*(\d+)", http, re.I)
    named = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and named is not None and named != digest(payload):
        raise _Bad("payload digest differs")
    try:
        page, refers = _page_id(head.get("warc-record-id")), _page_id(head.get("warc-refers-to"))
    except ValueError as e:
        raise _Bad("record id is no UUID") from e
    n = len(payload) if kind == "response" else int(full[1]) if full else None
    return {
        "page_id": page, "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": refers,
        "payload_bytes": n, "payload_digest": named, "payload": payload if kind == "response" else None,
    }, end + 4


def salvage(data: bytes):
    """Yields ("record", start, end, record) and ("gap", start, end, reason) over the bytes of an archive; all that a gzip member
    holds has the member's start and end."""
    at = 0
    while at < len(data):
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                content, end = _member(data, at)
                for kind, a, b, what in salvage(content):
                    yield kind, at, end, what if kind == "record" else f"bytes {a} to {b} of the member: {what}"
            else:
                found, end = _one(data, at)
                yield "record", at, end, found
        except _Bad as bad:
            following = _START.search(data, at + 1)
            end = following.start() if following else len(data)
            yield "gap", at, end, str(bad)
        at = end


_READ = (
    "file string, kind string, start long, end long, reason string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)
_FIELDS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
_ARROW = pa.schema(
    [("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()),
     ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``, adjoining ones with equal reason apart) under ``path``."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, end, what in salvage(content.as_py()):
                    row = {"file": file.as_py(), "kind": kind, "start": start, "end": end}
                    rows.append(row | (what if kind == "record" else {"reason": what}))
                    size += end - start
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _READ)
