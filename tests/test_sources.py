"""Readers on files of our own."""

import json
import random
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from weftwork import indexing
from weftwork.operators import lookups
from weftwork.sources import archives, helpbook, lint, metadata, modules, objects, paths, sqlite, stores
from weftwork.streaming import reindex


def test_lint_reports(spark, tmp_path):
    diag = {"code": "X1", "severity": "Error", "message": "m", "range": {"start": {"line": 4, "character": 0}}}
    (tmp_path / "a.json").write_text(json.dumps({"fileinfos": [{"path": "p", "diagnostics": [diag]}, {"path": "q", "diagnostics": []}]}))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text(json.dumps([{"severity": 2, "location": {"line": 1, "column": 2}, "source": "s"}]))
    assert sorted(tuple(r) for r in lint.read_reports(spark, str(tmp_path / "c.json")).collect()) == [("s", "UNKNOWN", "warning", "", 2, 3)]
    (tmp_path / "c.json").unlink()
    assert [tuple(r) for r in lint.read_reports(spark, str(tmp_path)).collect()] == [("p", "X1", "critical", "m", 5, 1)]


def test_methods(spark, tmp_path):
    text = "﻿Процедура Первая(А, Б = 1) Экспорт\n\tx = 1;\nКонецПроцедуры\n\nAsync Function Ёлка()\n  Return 1;\nEndFunction\nfunction open_()"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "m.bsl").write_text(text, encoding="utf-8")
    (tmp_path / "other.txt").write_text("Процедура Чужая()")
    got = {(r.name, r.is_function, r.is_export, r.is_async, r.start_line, r.end_line) for r in modules.methods(modules.read_modules(spark, str(tmp_path))).collect()}
    assert got == {("Первая", False, True, False, 1, 3), ("Ёлка", True, False, True, 5, 7), ("open_", True, False, False, 8, 8)}


def test_object_attributes(spark, tmp_path):
    def attr(name, kind, fill=""):
        return f"<Attribute uuid='u'><Properties><Name>{name}</Name><Type>{kind}</Type>{fill}</Properties></Attribute>"

    ref, text = "<v8:Type>cfg:CatalogRef.Goods</v8:Type><v8:Type>xs:string</v8:Type>", "<v8:Type>xs:string</v8:Type>"
    section = f"<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>{attr('Unit', '<v8:Type>xs:int</v8:Type>')}</ChildObjects></TabularSection>"
    synonym = "<Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Заказ</v8:content></v8:item></Synonym>"
    body = f"<MetaDataObject><Document uuid='d-1'><Properties><Name>Order</Name>{synonym}</Properties><ChildObjects>{attr('Item', ref, '<FillChecking>Show</FillChecking>')}{attr('Note', text)}{attr('', text)}{section}<Form> Main </Form><Form/></ChildObjects></Document></MetaDataObject>"
    for folder, name, xml in (("Documents", "Order", body), ("Catalogs", "Broken", "<MetaDataObject><Cat"), ("Catalogs", "Empty", "<MetaDataObject><Catalog/></MetaDataObject>")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.xml").write_text(xml, encoding="utf-8")
    objects = metadata.read_objects(spark, str(tmp_path))
    assert {(r.type, r.name) for r in objects.collect()} == {("Document", "Order"), ("Catalog", "Broken"), ("Catalog", "Empty")}
    got = {tuple(r) for r in metadata.attributes(objects).collect()}
    assert got == {("Document", "Order", None, "Item", "СправочникСсылка.Goods", True), ("Document", "Order", None, "Note", "Строка", False), ("Document", "Order", "Rows", "Unit", "Число", False)}
    assert {r.name for r in objects.where("not well_formed").collect()} == {"Broken"}
    assert [tuple(r) for r in metadata.children(objects, "Form").collect()] == [("Document", "Order", 0, "Main")]
    assert [(r.uuid, r.synonym, r.comment) for r in metadata.properties(objects).where("name = 'Order'").collect()] == [("d-1", "Заказ", None)]


def _book(*pages, broken=False):
    out = b"\x00" * 16
    for name, html in pages:
        raw = zlib.compressobj(wbits=-15)
        data = raw.compress(html.encode()) + raw.flush()
        out += struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, 8, 0, 0, 0, len(data), len(html), len(name), 0) + name.encode() + data
    return out + b"PK\x03\x04\xff" * broken


def test_help_book(spark, tmp_path):
    page = '<html><h1 class="V8SH_pagetitle">Глобальный.Найти (Global.Find)</h1><p class="V8SH_chapter">Синтаксис:</p> Найти(&lt;Где&gt;) <p class="V8SH_chapter">Доступность:</p> <p>Сервер, тонкий клиент. Веб-клиент.</p></html>'
    (tmp_path / "a.hbk").write_bytes(_book(("p.html", page), ("q", "<!DOCTYPE html><p>no marker</p>"), ("r.bin", "x"), broken=True))
    (tmp_path / "b.hbk").write_bytes(_book(("p2.html", page.replace("Где", "Что"))))
    (tmp_path / "c.hbk").write_bytes(b"short")
    pages = helpbook.read_pages(spark, str(tmp_path))
    assert sorted(r.entry for r in pages.collect()) == ["p.html", "p2.html", "q"]
    (m,) = helpbook.methods(pages).collect()
    assert (m.name, m.name_en, m.category, m.source_file) == ("Найти", "Find", "Глобальный", "p.html")
    assert (m.signature, m.server, m.thin_client, m.web_client, m.is_procedure) == ("Найти( )", True, True, False, False)


def test_reindex_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo")
    for k in range(2):
        q = reindex.index_stream(reindex.stream_texts(spark, source, "*.txt"), target, state)
        q.awaitTermination(60)
        assert q.exception() is None
        got = sorted((r.path[-5:], r.pos, r.chunk) for r in reindex.read_index(spark, target).collect())
        assert got == [("a.txt", 0, "one"), ("a.txt", 2, "two")] + [("b.txt", 0, "three")] * k
        (tmp_path / "in" / "b.txt").write_text("three")


def test_parameters(spark):
    heads = ['Function F(Val A, Б = 1, Знач В = "x,)", Г = (1, 2)) Export', "Procedure P()", "Procedure Q(\n  A,\n\tB)", None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "id int, head string").select("id", modules.parameters(F.col("head")).alias("p")).orderBy("id").collect()
    got = [r.p and [tuple(x) for x in r.p] for r in rows]
    assert got[0] == [("A", True, None, False), ("Б", False, "1", True), ("В", True, '"x,)"', True), ("Г", False, "(1, 2)", True)]
    assert got[1:] == [[], [("A", False, None, False), ("B", False, None, False)], None]


def test_help_book_with_directory_and_salvage(spark, tmp_path):
    import io
    import zipfile

    def book(**kw):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.html", "<html>" + "a" * 500)
            z.writestr("inner.html", b"<html>" + b"PK\x03\x04" * 20, zipfile.ZIP_STORED)
            z.writestr("ж", "<!doctype html>b")
        return out.getvalue()

    want = ["a.html", "inner.html", "ж"]
    assert [n for n, _ in helpbook.entries(book())] == want
    assert [n for n, _ in helpbook.entries(b"before" * 9 + book())] == want
    cut = book()[: book().index(b"PK\x01\x02")]
    assert [n for n, _ in helpbook.entries(b"x" + cut)] == want
    hurt = bytearray(cut)
    hurt[40:44] = b"\xff" * 4
    assert [n for n, _ in helpbook.entries(bytes(hurt))] == want[1:]
    stream = io.BytesIO()
    with zipfile.ZipFile(type("Pipe", (), {"write": stream.write, "flush": stream.flush})(), "w", zipfile.ZIP_DEFLATED) as z:  # sizes in data descriptors
        z.writestr("a.html", "<html>" + "a" * 500)
        z.writestr("b.html", "<html>b")
    raw = stream.getvalue()
    assert [n for n, _ in helpbook.entries(raw[: raw.index(b"PK\x01\x02")])] == ["a.html", "b.html"]
    assert list(helpbook.entries(b"")) == [] and list(helpbook.entries(b"PK\x03\x04short")) == []


def test_large_help_books_are_read_by_runs(spark, tmp_path):
    """The same pages by runs of entries and whole; a book of over 2 GB, which no binary value holds."""
    import io

    def book(n, **kw):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(n):
                z.writestr(f"ж{i}" if i % 3 else f"p{i}.htm", f"<html>{i}" + "ab" * (i % 50) + "PK\x03\x04" * (i % 2), compress_type=zipfile.ZIP_STORED if i % 7 == 0 else zipfile.ZIP_DEFLATED)
        return out.getvalue()

    stream = io.BytesIO()
    with zipfile.ZipFile(type("Pipe", (), {"write": stream.write, "flush": stream.flush})(), "w", zipfile.ZIP_DEFLATED) as z:  # sizes in data descriptors
        for i in range(50):
            z.writestr(f"a{i}.html", "<html>" + "".join(chr(97 + i * k % 26) for k in range(9000)) * 20)
    full, piped = book(9000), stream.getvalue()
    hurt = bytearray(full)
    hurt[40:44] = b"\xff" * 4
    wrong = bytearray(full)
    wrong[full.rindex(b"PK\x01\x02")] = 0
    books = {"full": full, "before": b"x" * 99 + full, "cut": b"x" + full[:-22], "hurt": bytes(hurt), "hurtcut": bytes(hurt[:-22]), "wrong": bytes(wrong), "piped": piped, "pipedcut": piped[:-22], "note": full[:-2] + b"\x03\0abc", "empty": book(0), "no": b"", "short": b"PK\x03\x04short"}
    for name, data in books.items():
        (tmp_path / f"{name} 1.hbk").write_bytes(data)
    rows = lambda whole: sorted((r.path, r.entry, r.html) for r in helpbook.read_pages(spark, str(tmp_path), whole=whole).collect())
    want = rows(1 << 30)
    assert len(want) > 9000 * 5 and rows(-1) == want
    both = [helpbook.read_pages(spark, str(tmp_path), "full*", whole=w).orderBy("pos").select("entry").collect() for w in (0, 1 << 30)]
    assert both[0] == both[1]
    (tmp_path / "far").mkdir()
    with open(tmp_path / "far" / "far.hbk", "wb") as f:
        f.seek((1 << 31) + (1 << 20))
        f.write(full)
    assert helpbook.read_pages(spark, str(tmp_path / "far")).count() == 9000


def test_windows_of_help_books_are_small(tmp_path):
    class File:
        def __init__(self, data):
            self.data, self.at, self.most = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.most = max(self.most, n)
            return self.data[self.at : self.at + n]

    rng = random.Random(1)
    data = _book(*((f"p{i}.html", f"<html>{rng.randbytes(800).hex()}") for i in range(3000))) * 3 + b"\0" * helpbook.WINDOW
    assert len(data) > 4 * helpbook.WINDOW
    file = File(data)
    found = list(helpbook.salvaged(helpbook.View(file, len(data))))
    assert found == list(helpbook.salvaged(data)) and len(found) == 9000 and file.most <= helpbook.WINDOW


def test_packed_archives(spark, tmp_path):
    rows = [(f"{k}.zip", f"{'ж' if i % 2 else 'n'}{i}", f"text {i} " * (i % 9), k == 0) for k in range(2) for i in range(500)]
    files = spark.createDataFrame(rows, "archive string, entry string, content string, ended boolean").withColumn("content", F.encode("content", "UTF-8"))
    out = {r.archive: r.bytes for r in archives.pack(files.repartition(5), f"file://{tmp_path}", before=b"abc").collect()}
    assert out == {f"{k}.zip": (tmp_path / f"{k}.zip").stat().st_size for k in range(2)}
    with zipfile.ZipFile(tmp_path / "0.zip") as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == {e: t for a, e, t, _ in rows if a == "0.zip"}
        assert z.namelist() == sorted(z.namelist())
    whole, cut = ((tmp_path / f"{k}.zip").read_bytes() for k in range(2))
    assert whole[:-22] == cut and len(list(helpbook.entries(cut))) == 500


def test_registry_and_indexes(spark, tmp_path):
    import datetime

    import pytest

    path = str(tmp_path / "registry")
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = lambda *x: spark.createDataFrame(list(x), stores.REGISTRY_SCHEMA)
    assert stores.read_registry(spark, path).count() == 0 and stores.load_index(spark, path) is None
    stores.register(spark, path, rows(("ut", "1", "/a", day(1), None), ("ut", "1", "/b", day(2), None), ("bp", "2", "/c", day(1), None)))
    assert sorted((r.name, r.path) for r in stores.read_registry(spark, path).collect()) == [("bp", "/c"), ("ut", "/b")]
    with pytest.raises(ValueError):
        stores.register(spark, path, rows(("ut", "1", "/z", day(3), None)))
    stores.register(spark, path, rows(("ut", "1", "/z", day(3), None)), replace=True)
    stores.mark_indexed(spark, path, "ut", "1", F.lit(day(9)))
    assert [(r.path, r.indexed_at) for r in stores.read_registry(spark, path).where("name = 'ut'").collect()] == [("/z", day(9))]
    assert stores.unregister(spark, path, "bp", "2") and not stores.unregister(spark, path, "bp", "2")
    assert stores.read_registry(spark, path).count() == 1
    stores.drop_index(spark, path)
    assert stores.load_index(spark, path) is None
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.bsl").write_text("x")
    assert stores.newest_source(spark, str(tmp_path / "src")).first()[0] is not None


def test_rules_from_files(spark, tmp_path):
    for kind in ("p", "a"):
        (tmp_path / kind).mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"id": "one", "title": "Old", "tags": ["x"]}))
    (tmp_path / "p" / "2.yaml").write_text("id: one\ntitle: Нов\nseverity: critical\nregex_pattern: 'a+'\n")
    (tmp_path / "p" / "3.yaml").write_text("title: no id\n")
    (tmp_path / "p" / "4.json").write_text("{broken")
    (tmp_path / "a" / "5.json").write_text(json.dumps({"id": "one", "title": "T", "severity": "odd"}))
    (tmp_path / "a" / "6.json").write_text(json.dumps({"id": "two", "title": "T", "regex_pattern": "("}))
    (tmp_path / "a" / "7.json").write_text(json.dumps({"id": "two", "title": "ring"}))
    rules, problems = stores.read_rules(spark, {"pattern": str(tmp_path / "p"), "antipattern": str(tmp_path / "a")})
    assert sorted((r.type, r.id, r.title) for r in rules.collect()) == [("antipattern", "two", "ring"), ("pattern", "one", "Нов")]
    assert sorted((r.path[-6:], r.problem[:12]) for r in problems.collect()) == [("3.yaml", "id is missin"), ("4.json", "not readable"), ("5.json", "severity is "), ("6.json", "regex_patter")]
    got = lookups.search_kb(rules, "one", 5).collect()
    assert [(r.id, r.type, r.score) for r in got] == [("one", "pattern", 0.8)]
    assert lookups.rule_by_id(rules, "one").first().detect_method == "regex" and lookups.rule_by_id(rules, "none").count() == 0


def test_catalogue():
    import pytest

    text = "# paths\nROOT=/data\nIDX=${ROOT}/idx\n OUT = \"${IDX}/out\"\nLOOP=${LOOP}\nBAD=${NONE}"
    assert stores.catalogue(text, {"ROOT": "/env"}, ["OUT"]) == {"OUT": "/env/idx/out"}
    for name, error in (("LOOP", ValueError), ("BAD", KeyError), ("ABSENT", KeyError)):
        with pytest.raises(error):
            stores.catalogue(text, {}, [name])


def test_path_rules(spark):
    cases = {
        "CommonModules/A/Ext/Module.bsl": ("CommonModule", "CommonModule.A", "A"),
        "Catalogs/T/Ext/ObjectModule.bsl": ("ObjectModule", "Catalog.T", "T"),
        "Documents/D/Forms/F/Ext/Form/Module.bsl": ("FormModule", "Document.D.F", "F"),
        "Odds/O/Ext/ManagerModule.bsl": ("ManagerModule", "Odd.O", "O"),
        "CommonForms/C/Ext/Form/Module.bsl": ("FormModule", "CommonForm.C", "C"),
        "ChartsOfAccounts/H/Ext/ManagerModule.bsl": ("ManagerModule", "ChartOfAccounts.H", "H"),
        "Enums/E/Forms/F/Ext/Form/Module.bsl": ("FormModule", "Enum.E.F", "F"),
        "CommonForms/C/Module.bsl": ("FormModule", "CommonForm.C", "C"),
        "Ext/Session.bsl": ("Unknown", "Ext/Session.bsl", "Session"),
        "x.bsl": ("Unknown", "x.bsl", "x"),
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    info = paths.module_info(F.col("p"))
    assert {r[0]: (r[1], r[2], r[3]) for r in rows.select("p", info["kind"], info["ref"], paths.module_name(F.col("p"))).collect()} == cases
    files = spark.createDataFrame([(p, "t") for p in cases], "path string, text string")
    assert lookups.module_of(files, "Catalog.T", "ObjectModule").first().path == "Catalogs/T/Ext/ObjectModule.bsl"
    assert lookups.module_of(files, "ChartOfAccounts.H", "ManagerModule").count() == 1 and lookups.module_of(files, "CommonForm.C", "FormModule").first().path == "CommonForms/C/Ext/Form/Module.bsl"
    assert lookups.module_of(files, "CommonModule.A", "ObjectModule").count() == 0 and lookups.module_of(files, "CommonModule.A", "CommonModule").count() == 1
    assert lookups.module_of(files, "Document.D", "FormModule").count() == 1 and lookups.module_of(files, "Catalog.%", "ObjectModule").count() == 0
    assert rows.select(paths.relative(F.lit("file:///a/b/Catalogs/%D0%96.xml"), "/a/b")).first()[0] == "Catalogs/Ж.xml"
    for path, root, rest in (("file:/a/a/x", "file:///a", "a/x"), ("file:///a/a/x", "/a/", "a/x"), ("s3a://b/d/x+y", "s3a://b/d", "x+y"), ("file:/w/d/m/x", "d/m", "x"), ("file:/w/$d/x", "/w/$d", "x")):
        assert rows.select(paths.relative(F.lit(path), root)).first()[0] == rest


def test_configuration_and_forms_from_files(spark, tmp_path):
    (tmp_path / "Configuration.xml").write_text("﻿<x:MetaDataObject><Configuration><Properties><Name>Root</Name><CompatibilityMode>Version8_3_24</CompatibilityMode></Properties><ChildObjects><Catalog>A</Catalog><Catalog>B</Catalog><Role>R</Role></ChildObjects></Configuration></x:MetaDataObject>", encoding="utf-8")
    c = objects.configuration(spark, str(tmp_path)).first()
    assert (c.name, c.platform_version, c.version, c.object_counts) == ("Root", "8.3.24", "0.0.0.0", {"Catalog": 2, "Role": 1})
    folder = tmp_path / "Catalogs" / "A" / "Forms"
    (folder / "Main" / "Ext").mkdir(parents=True)
    (folder / "Main.xml").write_text("<MetaDataObject><Form><Properties><Name>Main</Name><FormType>Managed</FormType></Properties></Form></MetaDataObject>")
    (folder / "Main" / "Ext" / "Form.xml").write_text("<Form><Events><Event name='OnOpen'>H</Event></Events><ChildItems><Group name='G'><ChildItems><Field name='F'/></ChildItems></Group></ChildItems></Form>")
    (folder / "Bare.xml").write_text("<MetaDataObject><Form><Properties/></Form></MetaDataObject>")
    rows = objects.read_forms(spark, str(tmp_path))
    got = {r.name: r for r in objects.forms(rows).collect()}
    assert set(got) == {"Main", "Bare"} and got["Main"].events == {"OnOpen": "H"} and got["Bare"].events == {} and got["Bare"].parent_name == "A"
    assert [(r.depth, r.element) for r in objects.form_elements(rows).orderBy("depth").collect()] == [(0, "G"), (1, "F")]
    assert lookups.form_by_name(objects.forms(rows), "Catalog.A", "Main").count() == 1


def _zip(path, files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)


def test_archives_are_hoisted_and_told_by_their_problems(spark, tmp_path):
    _zip(tmp_path / "a.zip", [("ut/Configuration.xml", "<a/>"), ("ut/Catalogs/G.xml", "<g/>"), ("readme.txt", "r"), ("ut/empty/", "")])
    _zip(tmp_path / "b.zip", [("x/Configuration.xml", "1"), ("y/Configuration.xml", "2")])
    _zip(tmp_path / "c.zip", [("Configuration.xml", "1"), ("sub/Configuration.xml", "2"), ("../out.txt", "3")])
    _zip(tmp_path / "d.zip", [])
    _zip(tmp_path / "e.zip", [("f.txt", "1")])
    (tmp_path / "f.zip").write_bytes(b"no archive")
    rows = archives.hoisted(archives.read_archives(spark, str(tmp_path))).collect()
    got = {}
    for r in rows:
        got.setdefault(r["archive"][-5], set()).add((r["entry"], r["problem"]))
    assert got["a"] == {("Configuration.xml", None), ("Catalogs/G.xml", None), ("readme.txt", None)}
    assert got["b"] == {("x/Configuration.xml", "several Configuration.xml"), ("y/Configuration.xml", "several Configuration.xml")}
    assert got["c"] == {("Configuration.xml", None), ("sub/Configuration.xml", None), ("../out.txt", "outside of the archive")}
    assert got["d"] == {(None, "empty")}
    assert got["e"] == {("f.txt", "no Configuration.xml")}
    assert got["f"] == {(None, "not readable: BadZipFile")}


def test_archive_to_indexes(spark, tmp_path):
    attr = "<Attribute><Properties><Name>Item</Name><Type><Type>cfg:CatalogRef.Goods</Type></Type></Properties></Attribute>"
    order = f"<MetaDataObject><Document uuid='d-1'><Properties><Name>Order</Name></Properties><ChildObjects>{attr}</ChildObjects></Document></MetaDataObject>"
    code = "Процедура Первая() Экспорт\n  Вторая();\nКонецПроцедуры\nФункция Вторая(А) Экспорт\n  Общий.Первая();\nКонецФункции\n"
    _zip(tmp_path / "ut.zip", [("ut/Configuration.xml", "<MetaDataObject/>"), ("ut/Documents/Order.xml", order), ("ut/Catalogs/Broken.xml", "<MetaDataObject><Cat"), ("ut/CommonModules/Общий/Ext/Module.bsl", code)])
    registry, target, out = (f"file://{tmp_path}/{n}" for n in ("registry", "dump", "indexes"))
    assert archives.add_archive(spark, registry, str(tmp_path / "ut.zip"), target, "ut", "1") == 4
    with pytest.raises(ValueError, match="registered"):
        archives.add_archive(spark, registry, str(tmp_path / "ut.zip"), target, "ut", "1")
    (tmp_path / "bad.zip").write_bytes(b"PK")
    with pytest.raises(ValueError, match="not readable"):
        archives.add_archive(spark, registry, str(tmp_path / "bad.zip"), f"{target}2", "ut", "2")
    assert [r["fresh"] for r in indexing.fresh(spark, registry).collect()] == [False]
    sizes = indexing.build_registered(spark, registry, out, "ut")["1"]
    assert sizes == {"objects": 2, "attributes": 1, "modules": 1, "api_reference": 1, "call_graph": 3, "dependency_graph": 1, "chunks": 2}
    load = lambda i: stores.load_index(spark, indexing.index_path(out, "ut", "1", i))
    assert {(r["name"], r["well_formed"], r["uuid"]) for r in load("objects").collect()} == {("Order", True, "d-1"), ("Broken", True, None)}
    assert {r["name"]: r["repairs"] for r in load("objects").collect()} == {"Order": None, "Broken": ["closed tags: 1", "closed at the end: 2"]}
    assert lookups.object_by_ref(load("objects"), "Document.Order").first()["uuid"] == "d-1"
    assert [r["name"] for r in lookups.api_of(load("api_reference"), "Общий").collect()] == ["Первая", "Вторая"]
    assert [tuple(r)[:2] for r in load("dependency_graph").collect()] == [("Document.Order", "Catalog.Goods")]
    assert {(r["src_method"], r["dst"], r["dst_method"]) for r in load("call_graph").collect()} == {("Первая", None, "Вторая"), ("Вторая", "CommonModule.Общий", "Первая"), ("Вторая", None, "Первая")}
    assert indexing.build_registered(spark, registry, out, "ut") == {"1": None}
    assert indexing.build_registered(spark, registry, out, "ut", "1", force=True) == {"1": sizes}
    with pytest.raises(KeyError):
        indexing.build_registered(spark, registry, out, "other")


def test_sqlite_tables(spark, tmp_path):
    for name, rows in (("a.db", [("М1", "s", 1, 0), ("М2", None, 0, None)]), ("b.db", [("М2", "t", 1, 1)])):
        with sqlite3.connect(tmp_path / name) as db:
            db.execute("CREATE TABLE platform_methods (id INTEGER PRIMARY KEY, name TEXT, signature TEXT, server INTEGER, thin_client INTEGER)")
            db.executemany("INSERT INTO platform_methods (name, signature, server, thin_client) VALUES (?, ?, ?, ?)", rows)
    with sqlite3.connect(tmp_path / "other.db") as db:
        db.execute("CREATE TABLE x (y)")
    got = {tuple(r) for r in sqlite.read_table(spark, str(tmp_path), "platform_methods", "name string, server boolean, thin_client boolean, web_client boolean").drop("path").collect()}
    assert got == {("М1", True, False, None), ("М2", False, None, None), ("М2", True, True, None)}
    assert sorted(r["name"] for r in sqlite.platform_methods(spark, str(tmp_path)).collect()) == ["М1", "М2"]
    with pytest.raises(ValueError, match="no SQLite type"):
        sqlite.read_table(spark, str(tmp_path), "x", "y array<int>")
