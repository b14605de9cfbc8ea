"""WARC archives: a writer with revisit records and a salvaging reader.

The writer stores one gzip member per record, so a damaged record costs only
itself. The reader checks each member's compression, header, block length and
block digest. Where a check fails it searches for the next place where a record
can begin, a gzip member or a ``WARC/`` version line, goes on there, and logs the
bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.sources.shared import Workspace

VERSION = b"WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
TASK_BYTES = 1 << 30
READ_BYTES = 1 << 18
PIECE_BYTES = 1 << 15
HEADER_BYTES = 1 << 16
_MEMBER = b"\x1f\x8b\x08"
_FIELD = re.compile(rb"[!-9;-~]*[ \t]*(?::|\Z)")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r?\n")


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1 without the algorithm's name."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, url: str, block: bytes, more: dict[str, str]) -> bytes:
    """One WARC record; header values lose line breaks."""
    content = "application/http; msgtype=response"
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": EPOCH, "WARC-Target-URI": url, "WARC-Block-Digest": f"sha1:{digest(block)}", **more, "Content-Type": content, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields.items())
    return VERSION + b"\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A recovered record or, with ``kind`` gap, a quarantined stretch of bytes."""

    kind: str
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""


class _Window:
    """A file seen through a buffer that can be extended and moved on."""

    def __init__(self, file: BinaryIO):
        self.file, self.at, self.data, self.ended = file, 0, bytearray(), False

    def need(self, n: int) -> bool:
        while len(self.data) < n and not self.ended:
            more = self.file.read(max(READ_BYTES, n - len(self.data)))
            self.ended = not more
            self.data += more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def seek_start(self) -> None:
        """Move on, by one byte at least, to where the next record can begin, or to the end."""
        self.skip(1)
        while self.need(1):
            if hit := _STARTS.search(self.data):
                self.skip(hit.start())
                return
            if self.ended:
                self.skip(len(self.data))
                return
            self.skip(max(0, len(self.data) - 16))  # a start may be cut by the buffer's end
            self.need(len(self.data) + READ_BYTES)


def _parse(raw: bytes) -> tuple[dict[str, str], bytes, int] | str:
    """Header fields, block and bytes used of a record at the start of ``raw``, or what is wrong."""
    end = raw.find(b"\r\n\r\n")
    if not re.match(rb"WARC/\d+\.\d+\r\n", raw):
        return "no version line"
    if end < 0:
        return "header not ended"
    headers = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "header line without a colon"
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "bad content length"
    begin, stop = end + 4, end + 4 + int(size)
    if len(raw) < stop + 4:
        return "block cut short"
    block = raw[begin:stop]
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return "block not ended"
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        return "block digest differs"
    return headers, block, stop + 4


def _member(window: _Window) -> tuple[bytes, int] | str:
    """The content of the gzip member at the window's start, and its length."""
    inflate, out, at = zlib.decompressobj(31), [], 0
    try:
        while not inflate.eof:
            if not window.need(at + 1):
                return "member cut short"
            piece = bytes(window.data[at : at + PIECE_BYTES])
            out.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error:
        return "member damaged"
    return b"".join(out), at - len(inflate.unused_data)


def _plain(window: _Window) -> tuple[dict[str, str], bytes, int] | str:
    """The uncompressed record at the window's start."""
    reach, start = HEADER_BYTES, 0
    window.need(reach)
    if not re.match(rb"WARC/\d+\.\d+\r\n", window.data):
        return "no version line"
    while (end := window.data.find(b"\r\n\r\n", start)) < 0:
        start = len(window.data) - 3
        # a damaged header is followed no further than to a line that can't be one of its fields
        if window.ended or not all(_FIELD.match(line) for line in window.data.rstrip(b"\r").split(b"\r\n")[1:]):
            return "header not ended"
        reach *= 2
        window.need(reach)
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n", window.data[: end + 2])
    whole = end + 8 + int(size[1]) if size else end + 4
    window.need(whole)
    return _parse(bytes(window.data[:whole]))


def _next_record(window: _Window) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and length in the file of the record at the window's start, or what is wrong."""
    window.need(16)
    if window.data.startswith(b"WARC/"):
        return _plain(window)
    if not window.data.startswith(_MEMBER):
        return "no record begins here"
    got = _member(window)
    if isinstance(got, str):
        return got
    parsed = _parse(got[0])
    if isinstance(parsed, str):
        return parsed
    return (parsed[0], parsed[1], got[1]) if parsed[2] == len(got[0]) else "member holds more than its record"


def salvage(file: BinaryIO) -> Iterator[Found]:
    """All records that pass their checks, in order, and the gaps between them.

    Members and plain records may be mixed. One record and the read buffer are
    held in memory at a time.
    """
    window = _Window(file)
    lost: Found | None = None
    while window.need(1):
        got = _next_record(window)
        if isinstance(got, str):
            lost = lost or Found("gap", window.at, 0, reason=got)
            window.seek_start()
            continue
        if lost:
            lost.length = window.at - lost.offset
            yield lost
            lost = None
        yield Found("record", window.at, got[2], got[0], got[1])
        window.skip(got[2])
    if lost:
        lost.length = window.at - lost.offset
        yield lost


def _open(path: str):
    """The file system of a path and the name in it; Hadoop's names of S3 are understood."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _written(folder: str, limit: int):
    """Rows to archives of about ``limit`` bytes; what comes out names the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        # a retried or doubled task writes files of its own: only returned names are read
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, _ = _open(folder)
        done: list[tuple[str, int, int]] = []
        out, count, size, name = None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, sha1, newest in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "sha1", "newest"))):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, count, size = system.open_output_stream(_open(name)[1], compression=None), 0, 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                more = {"WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "WARC-Payload-Length": str(len(payload))}
                if newest is None or newest == page_id:
                    raw = record("response", f"<urn:page:{page_id}>", url or "", HTTP_HEAD + payload, more)
                else:
                    more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{newest}>"}
                    raw = record("revisit", f"<urn:page:{page_id}>", url or "", HTTP_HEAD, more)
                member = gzip.compress(raw, 4, mtime=0)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= limit:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into archives under ``work``; returns ``(path, records, bytes)``.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest id is the response, others revisit it. Null payloads are empty. Rows
    that repeat the largest id are responses too, as are rows without an id. The
    folder must be one that every executor reaches through ``pyarrow.fs``.
    """
    folder = f"{work.path}/archives"
    system, name = _open(folder)
    system.create_dir(name, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    largest = rows.where(F.col("id").isNotNull() & (size >= least)).groupBy("sha1").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("sha1", "newest")
    largest = work.save(largest, "newest")  # saved before it is joined: a common payload's rows can then be dealt to several tasks
    long_enough = rows.withColumn("_key", F.when((size >= least) & F.col("id").isNotNull(), F.col("sha1")))
    joined = long_enough.join(largest.withColumnRenamed("sha1", "_key"), "_key", "left").select("id", "url", "html", "sha1", "newest")
    return work.save(joined.mapInArrow(_written(folder, limit), "path string, records long, bytes long"), "manifest")


def spread_archives(manifest: DataFrame) -> DataFrame:
    """The manifest's paths over as many partitions as their bytes ask for; a task streams its archives one after the other."""
    total = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    wanted = max(manifest.sparkSession.sparkContext.defaultParallelism, (total["bytes"] or 0) // TASK_BYTES)
    return manifest.select("path").repartition(max(1, min(total["n"], wanted)))


def read_warc(paths: DataFrame) -> DataFrame:
    """Every record and gap of the archives in column ``path``.

    Columns: ``path, kind (record or gap), offset, length, reason, headers
    (map, names in lower case), block``. A gap's ``reason`` says which check failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
        names = ["path", "kind", "offset", "length", "reason", "headers", "block"]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as file:
                    rows, held = [], 0
                    for x in salvage(file):
                        rows.append((path, x.kind, x.offset, x.length, x.reason, list(x.headers.items()), x.block))
                        held += len(x.block)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "path string, kind string, offset long, length long, reason string, headers map<string,string>, block binary"
    return paths.select("path").mapInArrow(run, schema)


def payload(block: bytes) -> bytes:
    """What follows the HTTP head of a block."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else block


def page_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Pages of ``read_warc``: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    Gaps give no rows; with ``strict`` the first gap raises an error that names its
    file, place and reason.

    A response's length and digest are measured on its recovered payload; a
    revisit's are those its header gives for the payload it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist()):
                h = dict(headers)
                page = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-record-id", ""))
                target = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
                if h.get("warc-type") == "revisit":
                    size, sha1 = int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                else:
                    body = payload(block)
                    size, sha1 = len(body), digest(body)
                rows.append((int(page[1]) if page else None, size, sha1, h.get("warc-type"), int(target[1]) if target else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    if strict:
        lost = F.concat_ws(" ", F.lit("gap:"), "path", "offset", "reason")
        records = records.withColumn("kind", F.when(F.col("kind") == "gap", F.raise_error(lost)).otherwise(F.col("kind")))
    pages = records.where("kind = 'record' and headers['warc-type'] in ('response', 'revisit')").select("headers", "block")
    return pages.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
