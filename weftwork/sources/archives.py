"""ZIP archives of a dump: their entries as rows, and unpacking into a folder of the shared store."""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release, remove, rename
from .stores import read_registry, register

#: The file that stands in the root of a configuration's dump (fixed value).
ROOT_FILE = "Configuration.xml"
_BATCH_BYTES = 8 << 20
_SCHEMA = "archive string, entry string, content binary, problem string"


def _unsafe(name: str) -> bool:
    path = PurePosixPath(name.replace("\\", "/"))
    return not path.parts or path.is_absolute() or ".." in path.parts or ":" in path.parts[0]


def archive_rows(archive: str, data: bytes) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """(archive, entry, content, problem) of each file in an archive; what can't be read has a problem in place of content."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield archive, None, None, f"not readable: {type(e).__name__}"
        return
    with book:
        files = [i for i in book.infolist() if not i.is_dir()]
        if not files:
            yield archive, None, None, "empty"
        for info in files:
            if _unsafe(info.filename):
                yield archive, info.filename, None, "outside of the archive"
                continue
            try:
                yield archive, info.filename, book.read(info), None
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError) as e:
                yield archive, info.filename, None, f"not readable: {type(e).__name__}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.binary(), pa.string())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "entry", "content", "problem"])

    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for row in archive_rows(path.as_py(), data.as_py() or b""):
                rows.append(row)
                held += len(row[2] or b"")
                if held >= _BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def entries(archives: DataFrame) -> DataFrame:
    """(archive, entry, content, problem): one row a file of the archives in (path, content). An archive is one task's work;
    empty and broken ones give one row without an entry."""
    return archives.select("path", "content").mapInArrow(_rows, _SCHEMA)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """`entries` of an archive, or of all below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return entries(files)


def hoisted(rows: DataFrame, root_file: str = ROOT_FILE) -> DataFrame:
    """`rows` with the folder of the only `root_file` as the root of its archive; entries outside of it keep their names.

    An archive that has the file in its root stays as it is. Without the file, or with several and none in the root, every
    row of the archive has that as its problem, unless it has one of its own.
    """
    prefix = F.regexp_extract("entry", r"(?s)^(.*/)?[^/]*$", 1)
    marks = rows.where(F.substring_index("entry", "/", -1) == root_file).groupBy("archive").agg(F.count("*").alias("marks"), F.min(F.struct(F.length(prefix), prefix.alias("prefix")))["prefix"].alias("prefix"))
    both = rows.join(marks, "archive", "left")
    wrong = F.when(F.col("marks").isNull(), F.lit(f"no {root_file}")).when((F.col("marks") > 1) & (F.col("prefix") != ""), F.lit(f"several {root_file}"))
    below = F.when(wrong.isNull() & F.startswith("entry", "prefix"), F.substring(F.col("entry"), F.length("prefix") + 1, F.length("entry"))).otherwise(F.col("entry"))
    return both.select("archive", F.coalesce(below, "entry").alias("entry"), "content", F.coalesce("problem", wrong).alias("problem"))


def _write(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(target)
        for batch in batches:
            sizes = []
            for entry, content in zip(batch.column(0), batch.column(1), strict=True):
                path, data = f"{root}/{entry.as_py()}", content.as_py()
                folder = path.rpartition("/")[0]
                store.create_dir(folder, recursive=True)
                # Written beside its place and moved there, so that a second attempt never leaves half a file.
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["entry", "bytes"])

    return run


def unpack(rows: DataFrame, target: str) -> DataFrame:
    """Write the entries without a problem below `target` (an address of a store that pyarrow can open); (entry, bytes) of
    what was written. Of entries that repeat a name the greatest by content stays, whichever task comes first."""
    good = rows.where("problem is null and entry is not null").groupBy("entry").agg(F.max("content").alias("content"))
    return materialize(good.mapInArrow(_write(target), "entry string, bytes long"), "unpacked")


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for x in batch.column(2).to_pylist():
            z = zlib.compressobj(wbits=-zlib.MAX_WBITS)
            made.append((z.compress(x) + z.flush(), zlib.crc32(x), len(x)))
        data, check, size = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(check, pa.int64()), pa.array(size, pa.int64()), batch.column(3)], names=["archive", "entry", "data", "crc", "size", "ended"])


class _Archive:
    """A ZIP archive that is written as its entries come; its directory waits in a file of the task."""

    def __init__(self, store: pafs.FileSystem, path: str, before: bytes) -> None:
        folder = path.rpartition("/")[0]
        store.create_dir(folder, recursive=True)
        self.store, self.path, self.part = store, path, f"{folder}/.{uuid.uuid4().hex}"
        self.out, self.records = store.open_output_stream(self.part, buffer_size=1 << 20), tempfile.TemporaryFile()  # noqa: SIM115
        self.out.write(before)
        self.n, self.at, self.before = 0, 0, len(before)

    def add(self, entry: str, data: bytes, crc: int, size: int) -> None:
        name, flags = entry.encode(), 0 if entry.isascii() else 0x800
        fields = (flags, zipfile.ZIP_DEFLATED, 0, 0x21, crc, len(data), size, len(name))
        self.out.write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 20, *fields, 0) + name + data)
        far = struct.pack("<2HQ", 1, 8, self.at) if self.at >= 0xFFFFFFFF else b""
        self.records.write(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45 if far else 20, 45 if far else 20, *fields, len(far), 0, 0, 0, 0, min(self.at, 0xFFFFFFFF)) + name + far)
        self.n, self.at = self.n + 1, self.at + 30 + len(name) + len(data)

    def close(self, ended: bool) -> int:
        size, offset, n = self.records.tell(), self.at, self.n
        self.records.seek(0)
        while block := self.records.read(1 << 20):
            self.out.write(block)
        self.records.close()
        end = b""
        if n >= 0xFFFF or max(size, offset) >= 0xFFFFFFFF:
            end = struct.pack("<4sQ2H2L4Q4sLQL", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, offset, b"PK\x06\x07", 0, offset + size, 1)
        if ended:
            end += struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)
        self.out.write(end)
        self.out.close()
        self.store.move(self.part, self.path)
        return self.before + offset + size + len(end)


def _pack(target: str, before: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(target)
        name, ended, book, done = None, True, None, []
        for batch in batches:
            for archive, entry, data, crc, size, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if book:
                        done.append((name, book.close(ended)))
                    name, ended, book = archive, end, _Archive(store, f"{root}/{archive}", before)
                book.add(entry, data, crc, size)
        if book:
            done.append((name, book.close(ended)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "bytes"])

    return run


def pack(files: DataFrame, target: str, before: bytes = b"") -> DataFrame:
    """Write (archive, entry, content, ended) as ZIP archives below `target` (an address of a store that pyarrow can open);
    (archive, bytes) of what was written.

    Entries are compressed by all tasks and stand in the order of their names; an archive is one file, so that one task writes
    it, of which it holds one batch of entries. `before` comes first in each; without `ended`, one value for each archive,
    its end record is left out.
    """
    made = files.select("archive", "entry", "content", "ended").mapInArrow(_deflated, "archive string, entry string, data binary, crc long, size long, ended boolean")
    ordered = made.repartition("archive").sortWithinPartitions("archive", "entry", "data")
    return materialize(ordered.mapInArrow(_pack(target, before), "archive string, bytes long"), "packed")


def add_archive(spark: SparkSession, registry: str, archive: str, target: str, name: str, version: str, root_file: str | None = ROOT_FILE) -> int:
    """Unpack an archive into `target`, in place of what lies there, register it, and give the number of its files.

    A name and version that are registered already, and an archive that can't be read whole or has no root file, are a
    ValueError, and nothing is changed. Without `root_file`, as for a library, entries keep their names.
    """
    known = read_registry(spark, registry).where((F.col("name") == name) & (F.col("version") == version))
    if not known.isEmpty():
        raise ValueError(f"{name}:{version} is registered already")
    rows = read_archives(spark, archive)
    rows = materialize(rows if root_file is None else hoisted(rows, root_file), "entries")
    problem = rows.where("problem is not null").first()
    if problem is not None:
        release(rows)
        raise ValueError(f"{archive}: {problem['entry'] or 'archive'}: {problem['problem']}")
    # Unpacked beside the target, which is replaced once all files are there.
    fresh = f"{target.rstrip('/')}.{uuid.uuid4().hex}"
    written = unpack(rows, fresh)
    n = written.count()
    release(rows, written)
    remove(spark, target)
    rename(spark, fresh, target)
    entry = spark.range(1).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(target).alias("path"), F.current_timestamp().alias("added_at"), F.lit(None).cast("timestamp").alias("indexed_at"))
    register(spark, registry, entry)
    return n
