"""WARC archives: a writer with revisit records, and a salvage reader.

The writer makes one archive of gzip members, one record each, in every task, in the shared folder; an attempt writes
under a name of its own, so that a repeated task never damages a file. The reader checks each member and record; where a
check fails it searches for the next valid member (or version line, in plain archives and inside a member), goes on there,
and logs the bytes between as a quarantined gap. A member may hold many records, as in an archive that is compressed as one:
it is unpacked in windows, so that memory is bounded by the largest record, and records before a damaged place are kept.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, new_path, release, remove

_log = logging.getLogger(__name__)
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
_WINDOW = 1 << 15
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


class Record(NamedTuple):
    """offset, length: of the record in the archive, or of the member that it is in; inside: its place in that member."""

    offset: int
    length: int
    headers: dict[str, str]
    body: bytes
    inside: int = 0


class Gap(NamedTuple):
    """Bytes of the archive that gave no record; inside a member that is otherwise read, of its unpacked bytes."""

    offset: int
    length: int
    reason: str


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def format_record(headers: dict[str, object], body: bytes) -> bytes:
    """A record: version line, headers, empty line, block, two line ends."""
    lines = [VERSION] + [f"{k}: {_one_line(v)}".encode() for k, v in headers.items()] + [b"Content-Length: %d" % len(body)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes | bytearray, at: int = 0, ended: bool = True) -> tuple[dict[str, str], bytes, int] | str | None:
    """Headers, block and end of the record that begins at `at`, or what is wrong with it; None if more bytes, which may
    come while `data` is not `ended`, could make it whole."""
    if not _VERSION_LINE.match(data, at):
        return None if not ended and len(data) - at < 10 else "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers not ended" if ended else None
    headers = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header without colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not (n := headers.get("content-length", "")).isdigit():
        return "no content length"
    stop = end + 4 + int(n)
    if not ended and len(data) < stop + 4:
        return None
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "block not ended"
    body = bytes(data[end + 4 : stop])
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != payload_digest(body):
        return "block digest differs"
    return headers, body, stop + 4


def read_member(data: bytes, at: int) -> Iterator[Record | Gap | int | str]:
    """Records and inner gaps of the gzip member at `at`, then its end, or what is wrong with it. Record lengths are 0."""
    unpack, plain, pos, base = zlib.decompressobj(31), bytearray(), at, 0
    bad: int | None = None
    why, some = "", False
    while True:
        try:
            plain += unpack.decompress(data[pos : pos + _WINDOW])
        except zlib.error as e:
            yield f"member damaged: {e}"
            return
        pos += _WINDOW
        ended, p = unpack.eof, 0
        while p < len(plain):
            found = parse_record(plain, p, ended)
            if found is None:
                break
            if isinstance(found, str):
                if bad is None:
                    bad, why = base + p, found
                line = _VERSION_LINE.search(plain, p + 1)
                p = line.start() if line else len(plain) if ended else max(p + 1, len(plain) - 9)
                continue
            if bad is not None and some:
                yield Gap(at, base + p - bad, f"inside a member: {why}")
            elif bad is not None:
                yield Gap(at, base + p, f"inside a member: {why}")
            bad, some = None, True
            yield Record(at, 0, found[0], found[1], base + p)
            p = found[2]
        base += p
        del plain[:p]
        if ended:
            if not some:
                yield why or "empty member"
                return
            if bad is not None:
                yield Gap(at, base - bad, f"inside a member: {why}")
            yield min(pos, len(data)) - len(unpack.unused_data)
            return
        if pos >= len(data):
            yield "member not ended"
            return


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every valid record of an archive, gzip members or plain, with a Gap for each run of bytes that gave none."""
    at, bad, why = 0, None, ""
    while at < len(data):
        end: int | str = "nothing"
        held: Record | None = None
        if data.startswith(GZIP, at):
            for found in read_member(data, at):
                if isinstance(found, (int, str)):
                    end = found
                    continue
                if bad is not None:
                    yield Gap(bad, at - bad, why)
                    bad = None
                if held is not None:
                    yield held
                held = None if isinstance(found, Gap) else found
                if isinstance(found, Gap):
                    yield found
            if held is not None:  # the last record; the only one of a whole member has the member's length
                yield held._replace(length=end - at if isinstance(end, int) and not held.inside else 0)
        else:
            plain = parse_record(data, at)
            if isinstance(plain, str):
                end = plain
            else:
                if bad is not None:
                    yield Gap(bad, at - bad, why)
                    bad = None
                headers, body, end = plain
                yield Record(at, end - at, headers, body)
        if isinstance(end, int):
            at = end
            continue
        if bad is None:
            bad, why = at, end
        line = _VERSION_LINE.search(data, at + 1)
        ahead = [p for p in (data.find(GZIP, at + 1), line.start() if line else -1) if p >= 0]
        at = min(ahead, default=len(data))
    if bad is not None:
        yield Gap(bad, len(data) - bad, why)


class Archive:
    """A growing archive of one task: files of about `most` bytes each."""

    def __init__(self, folder: str, most: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.most = most
        self.out, self.path, self.size = None, "", 0

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.size >= self.most:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.path, self.size = f"{self.root}/part-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(self.path)
        at = self.size
        self.out.write(member)
        self.size += len(member)
        return self.path, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, most)
        files: dict[str, list[int]] = {}
        for batch in batches:
            for key, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                key, refers = key.as_py(), refers.as_py()
                payload = (html.as_py() or "").encode()
                headers: dict[str, object] = {
                    "WARC-Type": "response" if refers is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>",
                    "WARC-Date": _EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"),
                    "WARC-Target-URI": url.as_py() or "",
                    "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
                    "X-Page-ID": key,
                    "X-Payload-Length": len(payload),
                }
                block = payload
                if refers is not None:
                    block = b""
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>", "X-Refers-To-Page": refers}
                headers |= {"WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "text/html; charset=utf-8"}
                member = gzip_member(format_record(headers, block))
                path, _ = archive.add(member)
                tally = files.setdefault(path, [0, 0])
                tally[0] += 1
                tally[1] += len(member)
        archive.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(files), pa.string()), pa.array([n for n, _ in files.values()], pa.int64()), pa.array([b for _, b in files.values()], pa.int64())], names=["path", "n_records", "n_bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_payload: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Write a record for each row into `folder` and return the manifest (path, n_records, n_bytes), already written.

    Of rows with equal payloads of at least `least_payload` bytes the smallest id is the response and the others are
    revisits of it; smaller payloads are all responses. A null html is an empty payload; rows with a null id are left out;
    of rows that repeat an id, each gets a record. Line ends in a url become a space.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).where("id is not null")
    rows = rows.withColumn("digest", F.sha1("html"))
    copies = rows.where(F.octet_length("html") >= least_payload).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    marked = rows.join(copies, "digest", "left").select("id", "url", "html", F.when(F.octet_length("html") >= least_payload, F.nullif(F.col("first"), F.col("id"))).alias("refers"))
    return materialize(marked.mapInArrow(_write(folder, file_bytes), "path string, n_records long, n_bytes long"), "manifest")


_READ = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string())])


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as f:
                    data = f.read()
                rows = []
                for r in salvage(data):
                    if isinstance(r, Gap):
                        rows.append((None, None, None, None, None, None, None, path, r.offset, r.length, r.reason))
                    else:
                        rows.append(_row(path, r, with_payload))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)


def _row(path: str, r: Record, with_payload: bool) -> tuple:
    h = r.headers
    revisit = h.get("warc-type") == "revisit"
    size = int(h["x-payload-length"]) if revisit else len(r.body)
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else payload_digest(r.body)
    refers = h.get("x-refers-to-page")
    return int(h["x-page-id"]), h.get("warc-target-uri"), h.get("warc-type"), size, digest, int(refers) if refers else None, r.body if with_payload else None, path, r.offset, r.length, None


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives in the manifest; gaps have a reason in `gap` and no id.

    A response's size and digest come from the block that was read; a revisit's from its headers, which carry those of the
    full payload. Archives are dealt out by path; each is of bounded size (`file_bytes` of the writer, or one record).
    """
    spec = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string, offset long, length long, gap string"
    return manifest.select("path").repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, 2)).mapInArrow(_read(folder, with_payload), spec)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write `pages` into the shared folder and return one row for each record that is read back.

    Rows with a null id have no record; rows that repeat an id have one each, of which with equal payloads any one is the
    response if no smaller id has it; other columns are ignored, whatever their
    names; an empty table gives no rows. What could not be read is logged: the number of gaps and their bytes, and the first
    ones by file and offset; `read_archives` returns all of them.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col=id_col, **options)
    got = materialize(read_archives(manifest, folder, with_payload=False).drop("payload"), "records")
    gaps = got.where("gap is not null")
    n, lost = gaps.agg(F.count("*"), F.sum("length")).first()
    if n:
        _log.warning("%d gaps with %d bytes in %s", n, lost, folder)
        for r in gaps.orderBy("path", "offset").limit(20).collect():
            _log.warning("gap of %d bytes at %d of %s: %s", r.length, r.offset, r.path, r.gap)
    remove(pages.sparkSession, folder)
    release(manifest)
    return got.where("gap is null").select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
