"""WARC archives: a writer, and a reader that splits gzip files by byte ranges.

Every record is a gzip member of its own. The writer's tasks put files below a shared folder
and report each finished file; the reports are stored as a table (the manifest), and only
files named there count, so files of lost or repeated attempts are never read.

A reading task owns a byte range of a file. It looks for gzip magic from the range's start,
takes a place for a member only if it can be unpacked into a record's header (in steps, a
header may be of any length), and from the
first such place on follows member after member. It owns the records that start inside its
range and reads on past the end for the last one. A file's first record must start at its first
byte, and every record must be followed by another or by the end of the file, whose size must be
the stated one: so no damage stays unseen, the last record of a range vouches for the next range.
What does not hold stops the job, or is reported as a row, and the search for magic starts
anew, one byte further. UTF-8 payloads cannot contain the magic, and a chance
match inside packed data does not unpack to a header.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the smallest
page_id is a response, the others revisit it. Rows that repeat under the smallest page_id
are all responses; a row without page_id revisits, unless no row of its payload has one. A null
html is an empty payload, a null url has no target header; line ends and percent signs in a url,
and blanks around it, are percent-encoded, and decoded in records of this writer. No rows give no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.storage import stored

MAGIC = b"\x1f\x8b\x08"
VERSION, _START = b"WARC/1.1", b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed once it has this many bytes; a reading task owns this many of a file.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 32 << 20
#: Reading tasks at most; beyond, each reads several ranges.
TASKS = 20_000
#: Bytes read at once, and the bytes of a header read or unpacked in one step.
CHUNK_BYTES, HEADER_BYTES = 1 << 20, 64 << 10
#: Rows that leave a reading task in one batch hold about this much payload.
BATCH_BYTES = 8 << 20
#: Type of the rows that stand for damage, and what in a url is percent-encoded and decoded.
DAMAGED = "damaged"
_ENCODED, _DECODED = re.compile(r"[\r\n%]|\A[ \t]+|[ \t]+\Z"), re.compile("%(0D|0A|25|20|09)")

RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, so 5 hex and 4 base32 digits, at a time."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(
        F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, and as ``original`` the page_id that a revisit refers to.

    Only the smallest page_id per digest that occurs more than once is joined back; both
    sides are read from storage, so that a digest with very many rows can be split.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    firsts = (
        keyed.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    joined = keyed.join(stored(firsts, "first-payloads"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("original"))


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    block = _HTTP + (payload if original is None else b"")
    head = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _ENCODED.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url)))
    if original is not None:
        head += [("WARC-Refers-To", f"<urn:page:{original}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes records as from with_originals(); returns the stored manifest (path, bytes, records)."""
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        out, path, size, n = None, "", 0, 0

        def report() -> pa.RecordBatch:
            out.close()
            name = f"{folder}/{path.rpartition('/')[2]}"
            return pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                member = _record(*row, when)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    yield report()
                    out = None
        if out is not None:
            yield report()

    columns = records.select("page_id", "url", "payload", "digest", "original")
    return stored(columns.mapInArrow(write, "path string, bytes bigint, records bigint"), "warc-manifest")


class _Source:
    """Bytes of a file from any place on, read in chunks."""

    def __init__(self, path: str):
        system, name = _file_system(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def chunk(self, at: int, n: int = CHUNK_BYTES) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The unpacked member that starts here and the place after it; None if it is no whole member."""
    unpack = zlib.decompressobj(31)
    out, place = [], at
    try:
        while not unpack.eof:
            data = source.chunk(place)
            if not data:
                return None
            place += len(data)
            out.append(unpack.decompress(data))
    except zlib.error:
        return None
    return b"".join(out), place - len(unpack.unused_data)


def _starts_record(source: _Source, at: int) -> bool:
    """Whether a member here unpacks to a record's header, however long; only its last step is held."""
    unpack = zlib.decompressobj(31)
    data, place, head, version = b"", at, b"", False
    try:
        while not unpack.eof:
            if not data:
                data = source.chunk(place, HEADER_BYTES)
                place += len(data)
                if not data:
                    return False
            head += unpack.decompress(data, HEADER_BYTES)
            data = unpack.unconsumed_tail
            if not version and len(head) >= len(_START):
                if not head.startswith(_START):
                    return False
                version = True
            if version and b"\r\n\r\n" in head:
                return True
            if version:
                head = head[-3:]
    except zlib.error:
        return False
    return False


def _next_record(source: _Source, at: int, end: int) -> int | None:
    """The first place from ``at`` to before ``end`` where a record starts."""
    while at < end:
        data = source.chunk(at, min(CHUNK_BYTES, end - at) + len(MAGIC) - 1)
        place = data.find(MAGIC)
        while place >= 0:
            if at + place < end and _starts_record(source, at + place):
                return at + place
            place = data.find(MAGIC, place + 1)
        at += CHUNK_BYTES
    return None


def records_in(
    path: str, start: int, end: int, size: int | None = None, damage: Callable[[int], None] = lambda place: None
) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of the records that start in [start, end) of a file.

    ``damage`` is told each place from which on bytes belong to no record, as far as this range
    answers for it: what follows its records, the file's beginning and, if stated, its size.
    """
    source = _Source(path)
    if start == 0 and size not in (None, source.size):
        damage(min(size, source.size))
    at = _next_record(source, start, end)
    if start == 0 and at != 0 and source.size:
        damage(0)
    while at is not None and at < end:
        found = _member(source, at)
        head, mark, rest = found[0].partition(b"\r\n\r\n") if found else (b"", b"", b"")
        if not mark or not head.startswith(_START):
            damage(at)
            at = _next_record(source, at + 1, end)
            continue
        lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip(" \t") for k, _, v in lines}
        length = headers.get("content-length", "")
        yield headers, rest[: int(length) if length.isdigit() else len(rest)]
        at = found[1]
        if at >= source.size:
            return
        if source.chunk(at, len(MAGIC)) != MAGIC or at >= end and not _starts_record(source, at):
            damage(at)
            at = _next_record(source, at, end)


def _page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = headers.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2]
    url = headers.get("warc-target-uri")
    response = kind == "response"
    row = {
        "page_id": _page_of(headers.get("warc-record-id")),
        "url": _DECODED.sub(lambda m: chr(int(m[1], 16)), url) if url and "x-payload-length" in headers else url,
        "record_type": kind,
        "refers_to": _page_of(headers.get("warc-refers-to")),
        "payload_bytes": len(payload) if response else int(headers.get("x-payload-length", 0)),
        "payload_digest": _digest(payload) if response else headers.get("warc-payload-digest", "").removeprefix("sha1:"),
    }
    return row | ({"payload": payload} if with_payload else {})


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_archives(
    spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False, report_damage: bool = False
) -> DataFrame:
    """The records of files (path, bytes), each by the task whose byte range it starts in.

    Length and digest of a response are taken from the payload itself; a revisit has its
    record's own statements. Records that are neither are passed over. Damage raises an error
    that names file and place; with ``report_damage`` each such place becomes a row of type
    ``damaged``, with file and place as url, and all whole records are still read.
    """
    ranges = files.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    ).where("bytes > 0")
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end"), "bytes")
    schema = RECORDS + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + ([("payload", pa.binary())] if with_payload else [])
        )
        for batch in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0

                def damage(place: int) -> None:
                    if not report_damage:
                        raise ValueError(f"damaged archive {path} at byte {place}")
                    rows.append({"url": f"{path}:{place}", "record_type": DAMAGED})

                for headers, block in records_in(path, start, end, size, damage):
                    if headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) if with_payload else 256
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    # ranges are small rows, their work is large: their number of tasks is not left to adaptive execution
    return ranges.repartition(min(max(1, ranges.count()), TASKS)).mapInArrow(read, schema)
