"""Help books: archives of HTML pages, and the methods that the pages describe.

A book is a ZIP archive, often with bytes before it or without its directory. Where the directory can be read, entries come
from it; what it doesn't reach is salvaged by walking from one local header to the next, each entry ending where its own
data end. Pages are cut into titled sections by expressions.

Books of up to `WHOLE` bytes are read whole by their task. Of larger ones a task at a time holds some megabytes: one pass over
the directory cuts it into runs of `RUN` entries, which tasks of all executors unpack, each through a window of the file; a
book without a directory is walked by one task through such a window. Only an entry has to fit into memory.
"""

from __future__ import annotations

import io
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import strip_html

# Phrases of the availability text and the flag that each sets.
CONTEXTS = {
    "server": ("сервер",),
    "thin_client": ("тонкий клиент",),
    "web_client": ("веб-клиент", "веб клиент"),
    "mobile_client": ("мобильный клиент",),
    "thick_client": ("толстый клиент",),
    "external_connection": ("внешнее соединение",),
    "mobile_application": ("мобильное приложение (клиент)",),
    "mobile_client_application": ("мобильное приложение (сервер)", "мобильный автономный сервер"),
}


LOCAL = b"PK\x03\x04"
#: Bytes up to which a book is read whole, entries of a run, and bytes of a window and of a piece that is unpacked at once.
WHOLE, RUN, WINDOW, PIECE = 16 << 20, 4096, 1 << 20, 64 << 10


class View:
    """The bytes of an open file, read by slices; one window of it is held."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if a >= b:
            return b""
        if a < self.at or b > self.at + len(self.held):
            self.file.seek(a)
            self.at, self.held = a, self.file.read(min(max(b - a, WINDOW), self.size - a))
        return self.held[a - self.at : b - self.at]

    def find(self, what: bytes, at: int) -> int:
        while at + len(what) <= self.size:
            if not self.at <= at <= self.at + len(self.held) - len(what):
                self[at : at + WINDOW]
            found = self.held.find(what, at - self.at)
            if found >= 0:
                return self.at + found
            at = self.at + len(self.held) - len(what) + 1
        return -1


def entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of each entry that can be unpacked, in order; damaged ones are passed over."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            for info in book.infolist():
                try:
                    yield info.filename, book.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError):
                    continue
    except (zipfile.BadZipFile, OSError, ValueError, struct.error):
        yield from salvaged(data)


def salvaged(data: bytes | View) -> Iterator[tuple[str, bytes]]:
    """Entries of an archive without a directory, by its local headers."""
    view, at = memoryview(data) if isinstance(data, bytes) else data, data.find(LOCAL, 0)
    while at >= 0:
        name, content, end = local_entry(view, at)
        if content is not None:
            yield name, content
        # Behind a whole entry the next one follows; bytes inside its data are never taken for a header.
        at = data.find(LOCAL, max(end, at + len(LOCAL)))


def local_entry(view: memoryview | View, at: int) -> tuple[str, bytes | None, int]:
    """Name, content (None if damaged) and end of the entry whose local header is at `at`."""
    fixed = bytes(view[at + 4 : at + 30])
    if len(fixed) < 26:
        return "", None, len(view)
    flags, method = struct.unpack_from("<HH", fixed, 2)
    check, size, _, name_size, extra_size = struct.unpack_from("<IIIHH", fixed, 10)
    begin = at + 30 + name_size + extra_size
    name = bytes(view[at + 30 : at + 30 + name_size]).decode("utf-8", "replace")
    known = size > 0 and not flags & 8
    if begin > len(view):
        return name, None, at
    if method == zipfile.ZIP_STORED:
        return (name, bytes(view[begin : begin + size]), begin + size) if known and begin + size <= len(view) else (name, None, at)
    if method != zipfile.ZIP_DEFLATED:
        return name, None, begin + size if known else at
    unpack, pieces = zlib.decompressobj(-zlib.MAX_WBITS), []
    upto, last = begin, min(begin + size, len(view)) if known else len(view)
    try:
        while upto < last and not unpack.eof:
            pieces.append(unpack.decompress(view[upto : min(upto + PIECE, last)]))
            upto = min(upto + PIECE, last)
    except zlib.error:
        return name, None, at
    content = b"".join(pieces)
    if not unpack.eof or check and not flags & 8 and zlib.crc32(content) != check:
        return name, None, at
    return name, content, begin + size if known else upto - len(unpack.unused_data)


def directory_runs(view: View) -> list[tuple[int, int, int, int, int, int]] | None:
    """(first, n, lo, hi, begin, shift) of each run of a directory's entries: the place of its first entry, how many they
    are, where their records lie, with the next record behind them, where the directory begins, and by how many bytes
    before the archive its offsets are short. None if the directory is missing or broken."""
    size = len(view)
    tail = view[max(0, size - 22) :]
    at = size - 22
    if len(tail) < 22 or tail[:4] != b"PK\x05\x06" or tail[-2:] != b"\0\0":
        start = max(0, size - (1 << 16) - 22)
        at = start + view[start:].rfind(b"PK\x05\x06")
        tail = view[at : at + 22]
        if at < start or len(tail) < 22:
            return None
    length, offset = struct.unpack_from("<2L", tail, 12)
    locator, wide = view[max(0, at - 20) : at], view[max(0, at - 76) : max(0, at - 20)]
    if locator[:4] == b"PK\x06\x07" and len(wide) == 56 and wide[:4] == b"PK\x06\x06":
        length, offset = struct.unpack_from("<2Q", wide, 40)
        at -= 76
    begin = at - length
    if begin < 0 or begin < offset:
        return None
    starts, n, at = [], 0, begin
    while at < begin + length:
        head = view[at : at + 46]
        if len(head) < 46 or head[:4] != b"PK\x01\x02":
            return None
        end = at + 46 + sum(struct.unpack_from("<3H", head, 28))
        if n % RUN == 0:
            starts.append((at, end))
        at, n = end, n + 1
    more = [*starts[1:], (at, at)]
    return [(k * RUN, min(RUN, n - k * RUN), lo, more[k][1], begin, begin - offset) for k, (lo, _) in enumerate(starts)]


class _Run(io.RawIOBase):
    """The file up to its directory, and behind it a directory of one run's records."""

    def __init__(self, file, records: bytes, begin: int, shift: int) -> None:
        n, size, offset = 0, len(records), begin - shift
        at = 0
        while at < size:
            at, n = at + 46 + sum(struct.unpack_from("<3H", records, at + 28)), n + 1
        wide = struct.pack("<4sQ2H2L4Q4sLQL", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, offset, b"PK\x06\x07", 0, offset + size, 1)
        self.file, self.begin, self.at = file, begin, 0
        self.tail = records + wide + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.begin + len(self.tail))[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        if self.at < self.begin:
            self.file.seek(self.at)
            data = self.file.read(min(len(into), self.begin - self.at))
        else:
            data = self.tail[self.at - self.begin : self.at - self.begin + len(into)]
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def run_entries(file, records: bytes, n: int, begin: int, shift: int) -> Iterator[tuple[int, str, bytes]]:
    """(place in the run, name, content) of the first n entries of a run that can be unpacked."""
    with zipfile.ZipFile(io.BufferedReader(_Run(file, records, begin, shift), WINDOW)) as book:
        for k, info in enumerate(book.infolist()[:n]):
            try:
                yield k, info.filename, book.read(info)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError):
                continue


def _is_page(name: str, content: bytes) -> bool:
    """HTML by its suffix or, with any other name, by how it begins."""
    start = content[:200].lower()
    return name.lower().endswith((".html", ".htm")) or bool(name) and (b"<html" in start or b"<!doctype" in start)


def _batches(pages: Iterator[tuple[str, int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of 200 pages, or of some megabytes, of (path, pos, name, content)."""
    rows, held = [], 0
    for path, pos, name, content in pages:
        if _is_page(name, content):
            rows.append((path, pos, name, content.decode("utf-8", "replace")))
            held += len(content)
        if len(rows) == 200 or held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            yield from _batches((path.as_py(), pos, name, content) for pos, (name, content) in enumerate(entries(data.as_py())))


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each book (path, length); a book without a directory is one row, with n = -1."""
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = _store(path)
            with store.open_input_file(name) as file:
                runs = directory_runs(View(file, size))
            rows = [(path, size, *r) for r in (runs if runs is not None else [(0, -1, 0, 0, 0, 0)])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "size", "first", "n", "lo", "hi", "begin", "shift"])


def _run_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, name = _store(row["path"])
            with store.open_input_file(name) as file:
                if row["n"] < 0:
                    yield from _batches((row["path"], pos, *e) for pos, e in enumerate(salvaged(View(file, row["size"]))))
                    continue
                file.seek(row["lo"])
                found = run_entries(file, file.read(row["hi"] - row["lo"]), row["n"], row["begin"], row["shift"])
                yield from _batches((row["path"], row["first"] + k, *e) for k, *e in found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "pos", "entry", "html"])


def _can_open(spark: SparkSession, folder: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        _store(str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.hbk", whole: int = WHOLE) -> DataFrame:
    """(path, pos, entry, html) of the HTML entries of every container below a folder; pos grows with an entry's place.

    A container of up to `whole` bytes is read whole, a larger one by runs of its entries. In a store that Spark reads and
    pyarrow can't open all are read whole, so that there none may pass 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    schema = "path string, pos int, entry string, html string"
    if not _can_open(spark, folder):
        return files.select("path", "content").mapInArrow(_pages, schema)
    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(_pages, schema)
    runs = files.where(F.col("length") > whole).select("path", "length").mapInArrow(_runs, "path string, size long, first long, n long, lo long, hi long, begin long, shift long")
    # Dealt out by number, as such small rows would all be put into one task otherwise.
    return small.union(runs.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_run_pages, schema))


def sections(html: Column) -> Column:
    """array<struct(title, body)> of a page's chapters: the title without its colon, and the markup up to the next chapter
    or rule."""
    parts = F.slice(F.split(html, r"(?i)<p[^>]*class=[\"']?V8SH_chapter[\"']?[^>]*>"), 2, 1 << 30)
    title = lambda x: F.rtrim(F.trim(F.regexp_replace(F.regexp_extract(x, r"(?is)^(.*?)</p>", 1), "<[^>]*>", "")), F.lit(": "))
    return F.transform(parts, lambda x: F.struct(title(x).alias("title"), F.regexp_extract(x, r"(?is)^.*?</p>(.*?)(?:<hr\b.*)?$", 1).alias("body")))


def title_parts(title: Column) -> Column:
    """struct(category, name, name_en) of a title such as `Category.Name (Category.NameEn)`; the last brackets hold the
    English name."""
    open_at = F.length(title) - F.instr(F.reverse(title), "(") + 1
    brackets = F.contains(title, F.lit("(")) & title.endswith(")")
    own = F.when(brackets, F.trim(F.substring(title, F.lit(1), open_at - 1))).otherwise(title)
    english = F.when(brackets, F.rtrim(F.substring(title, open_at + 1, F.length(title)), F.lit(") ")))
    dotted = F.contains(own, F.lit("."))
    category = F.when(dotted, F.substring(own, F.lit(1), F.length(own) - F.length(F.substring_index(own, ".", -1)) - 1))
    return F.struct(F.nullif(category, F.lit("")).alias("category"), F.trim(F.substring_index(own, ".", -1)).alias("name"), F.nullif(F.substring_index(english, ".", -1), F.lit("")).alias("name_en"))


def contexts(text: Column) -> list[Column]:
    """A flag for each context that the first sentence of an availability text names."""
    first = F.lower(F.substring_index(text, ".", 1))
    return [F.coalesce(F.greatest(*[F.contains(first, F.lit(p)) for p in (*phrases, phrases[0])]), F.lit(False)).alias(name) for name, phrases in CONTEXTS.items()]


def methods(pages: DataFrame) -> DataFrame:
    """(name, name_en, category, signature, is_procedure, description, source_file, and a flag for each context): one row
    for each method name, the first by path and place. Pages without a title or without markers give none."""
    html = F.col("html")
    heading = strip_html(F.regexp_extract(html, r"(?is)<h1[^>]*V8SH_pagetitle[^>]*>(.*?)</h1>", 1))
    cut = pages.where(F.contains("html", F.lit("V8SH_"))).select("path", "pos", F.col("entry").alias("source_file"), title_parts(heading).alias("t"), sections(html).alias("s"))
    said = lambda k: F.coalesce(strip_html(F.get(F.filter("s", lambda e: e["title"] == k), F.lit(0))["body"]), F.lit(""))
    rows = cut.where("t.name <> ''").select("path", "pos", "source_file", "t.*", F.left(said("Синтаксис"), F.lit(200)).alias("syntax"), said("Доступность").alias("available"))
    rows = rows.select("*", *contexts(F.col("available"))).drop("available")
    first = F.row_number().over(Window.partitionBy("name").orderBy("path", "pos"))
    rows = rows.withColumn("n", first).where("n = 1").withColumn("signature", F.coalesce(F.nullif("syntax", F.lit("")), "name"))
    english = F.coalesce(F.concat(F.lit(" (en: "), "name_en", F.lit(")")), F.lit(""))
    group = F.coalesce(F.concat(F.lit(" | Категория: "), "category"), F.lit(""))
    return rows.select(
        "name",
        "name_en",
        F.coalesce("category", F.lit("Uncategorized")).alias("category"),
        "signature",
        F.col("signature").rlike(r"(?iu)^процедура|процедура ").alias("is_procedure"),
        F.concat(F.lit("Метод платформы 1С: "), "name", english, group).alias("description"),
        "source_file",
        *CONTEXTS,
    )
