"""Kept indexes, rule tables, repaired files and versioned tables on small hand-made inputs."""

import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork import scratch
from weftwork.operators import builders, graph, graph_index, rule_table, rules, search, text, text_index, vector_index
from weftwork.sources import archives, metadata, modules, rule_schema, stores, versioned, xml_repair


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vector_index_is_exact_and_prunes(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 12]], i % 3) for i in range(900)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(400)] + [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [1.0], 1)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    index = vector_index.build_index(df, "id", "v", str(tmp_path / "i"), lists=12)
    assert sum(r for _, r, _ in index.lists.values()) == len(rows) - 1 and index.lists[-1][1] == 2
    for q in (rows[0][1], rows[5][1], [0.3] * 8):
        want = [(r.id, r.score) for r in search.vector_search(df, "v", q, 10, "id").collect()]
        assert [(r.id, r.score) for r in vector_index.index_search(spark, index, q, 10, 1, exact=True).collect()] == want
    one = vector_index.index_search(spark, index, rows[0][1], 5, 1)
    assert re.search(r"PartitionFilters: \[weft_list#\d+ IN \(\d+,-1\)\]", plan(one))
    asked = df.where("id % 100 = 0")
    exact = vector_index.index_neighbours(asked, index, 10, None)
    brute = {}
    for q in (r for r in rows if r[0] % 100 == 0 and r[1]):
        got = search.vector_search(df.where(F.col("id") != q[0]), "v", q[1], 10, "id").collect()
        brute |= {(q[0], r.id): r.score for r in got}
    assert {(r["query"], r["id"]): r["score"] for r in exact.collect()} == pytest.approx(brute)
    assert vector_index.recall(vector_index.index_neighbours(asked, index, 10, 4), exact).first()["recall"] >= 0.9
    empty = vector_index.build_index(df.limit(0), "id", "v", str(tmp_path / "e"))
    assert empty.lists == {}


def test_neighbours_are_scored_one_by_one_only_where_they_can_be_near(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(3000)]
    rows += [(f"c{i}", rows[7][1]) for i in range(30)] + [("n", [None] + [1.0] * 5), ("z", [0.0] * 6), ("s", [2.0]), ("i", [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    index = vector_index.build_index(df, "id", "v", str(tmp_path / "i"), lists=2)
    asked = df.where("id in ('v7', 'v8', 'v9', 'n', 'z', 'c3', 's')")
    found = vector_index.index_neighbours(asked, index, 10, None)
    got = {(r["query"], r["id"], r["rank"]): r["score"] for r in found.collect()}
    a, b = asked.select(F.col("id").alias("query"), F.col("v").alias("asked")), df.select("id", F.col("v").alias("vector"))
    size = search.norm(F.col("vector")) * search.norm(F.col("asked"))
    dot = F.aggregate(F.zip_with("vector", "asked", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    brute = a.crossJoin(b).where("query <> id").withColumn("score", F.round(F.when(size > 0, dot / size).otherwise(F.lit(0.0)), 9)).withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    want = {(r["query"], r["id"], r["rank"]): r["score"] for r in brute.collect()}
    assert got.keys() == want.keys() and str(sorted(got.items())) == str(sorted(want.items())) and len(got) == 70
    assert "MapInArrow" in plan(found)  # pairs are compared in blocks


def test_text_index_equals_scans(spark, tmp_path):
    rng = random.Random(4)
    words = ["альфа", "beta", "Gamma", "x1", "the", "the", "the"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", ".", "\nend"])) for i in range(200)] + [(900, None), (901, ""), (902, "the " * 5000)]
    df = spark.createDataFrame(texts, "id int, t string")
    index = text_index.build_text_index(df, "id", "t", str(tmp_path / "t"), buckets=8)
    split = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    for said in ("the the beta", "x1", "the the", "нет", ""):
        w = said.split()
        want = {(i, p) for i, s in split.items() for p in range(len(s) - len(w) + 1) if w and s[p : p + len(w)] == w}
        assert {(r.id, r.place) for r in text_index.phrase(spark, index, said).collect()} == want
    assert {r.id for r in text_index.matching(spark, index, "Beta АЛЬФА").collect()} == {i for i, s in split.items() if {"beta", "альфа"} <= set(s)}
    assert {r.id for r in text_index.matching(spark, index, "beta альфа", every=False).collect()} == {i for i, s in split.items() if {"beta", "альфа"} & set(s)}
    for every in (False, True):
        want = {r.id: r.score for r in search.bm25(df, "id", "t", ["beta", "x1"], 20, every=every).collect()}
        assert {r.id: r.score for r in text_index.ranked_texts(spark, index, ["beta", "x1"], 20, every=every).collect()} == pytest.approx(want)
    found = index.postings(spark, ["beta"])
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", plan(found)) and "EqualTo(term,beta)" in plan(found)
    with pytest.raises(ValueError, match="no id"):
        text_index.build_text_index(df.union(df.limit(1)), "id", "t", str(tmp_path / "u"))


def test_text_index_shuffles_no_words(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(f"d{i}", " ".join(f"w{rng.randrange(400)}" for _ in range(600))) for i in range(400)], "id string, t string").coalesce(2)
    df.write.parquet(str(tmp_path / "d"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    written = lambda: sum(s.shuffleWriteRecords() for s in map(stages().apply, range(stages().size())))
    before = written()
    index = text_index.build_text_index(spark.read.parquet(str(tmp_path / "d")), "id", "t", str(tmp_path / "t"))
    assert written() - before < 20_000  # of 125,000 postings: a block for each term, and the ids that are checked
    assert index.texts == 400 and index.mean == 600
    assert text_index.matching(spark, index, "w1 w2").count() == df.where("concat(' ', t, ' ') like '% w1 %' and concat(' ', t, ' ') like '% w2 %'").count()
    none = text_index.build_text_index(df.where("false"), "id", "t", str(tmp_path / "n"))
    assert (none.texts, none.mean) == (0, 0.0) and text_index.matching(spark, none, "w1").count() == 0


def test_adjacency_equals_closures(spark, tmp_path):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("hub", f"n{i}") for i in range(40)] + [("a", "b"), ("b", "a"), ("b", "b"), (None, "a"), ("a", None), ("a", "b")]
    df = spark.createDataFrame(edges, "src string, dst string")
    index = graph_index.build_adjacency(df, str(tmp_path / "g"), buckets=8)
    for start, direction in (("hub", "out"), ("a", "out"), ("n5", "in"), ("none", "out")):
        want = {tuple(r) for r in graph.closure(df, start, 4, direction).collect()}
        assert {tuple(r) for r in graph_index.index_closure(spark, index, start, 4, direction).collect()} == want
        sides = sorted(map(tuple, graph.closure_edges(df, start, 2, direction).collect()), key=str)
        assert sorted(map(tuple, graph_index.index_closure_edges(spark, index, start, 2, direction).collect()), key=str) == sides
    found = graph_index.index_neighbours(spark, index, "a", "out")
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "b"), ("a", "b"), ("a", None)]
    assert re.search(r"PartitionFilters: \[.*weft_bucket#\d+ = \d+", plan(found))
    with pytest.raises(ValueError):
        graph_index.index_closure(spark, index, "a", 0)


def test_kept_is_built_once_and_again_after_a_change(spark, tmp_path):
    source, built = f"{tmp_path}/s", []

    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)

    spark.range(5).write.parquet(source)
    first = scratch.kept(spark, "x", [source], build)
    assert scratch.kept(spark, "x", [source], build) == first and len(built) == 1
    spark.range(6).write.mode("overwrite").parquet(source)
    assert scratch.kept(spark, "x", [source], build) != first


def test_a_scope_leaves_nothing_behind(spark):
    from weftwork.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    QUERIES["dep_transitive"](spark, sf).count()  # its index is kept
    before = set(scratch._made)
    for name in ("dep_transitive", "dep_dependents", "impact_count", "bm25_scan", "dep_closure_scan", "registry_upkeep", "similar_names"):
        with scratch.scope():
            assert QUERIES[name](spark, sf).count() >= 0
    assert set(scratch._made) - set(scratch._kept.values()) == before - set(scratch._kept.values())


@pytest.mark.parametrize(
    "pattern,wanted",
    [
        (r"ВЫБРАТЬ\s+\*", {"выбрать"}),
        (r"\bfoo(bar)?bazz", {"bazz"}),
        (r"(?:alpha|beta)x+", {"alpha", "beta"}),
        (r"(?:alpha|b)x+", set()),
        (r"[0-9]+", set()),
        (r"a(?=bcd)", set()),
        (r"(foo)+bar", {"foo"}),
        (r"x{0,2}abc", {"abc"}),
        (r"(?i:Abc)d", {"abcd"}),
        (r"abc|", set()),
        ("(", set()),
        (r"(?x)a b c", set()),
        (r"ab(cd)ef", {"abcdef"}),
        (r"a\.b\nc", {"a.b"}),
    ],
)
def test_necessary_literals(pattern, wanted):
    assert rule_table.necessary(pattern) == wanted


def test_rule_table_equals_each_rule_alone(spark):
    patterns = [r"\bfoo\w*", r"(?:alpha|beta|ALPHABET)\d", r"[0-9]{3}", r"SELECT\s+\*", r"^end$", r"a.b", r"sſk", r"ab", r"abc", r"bcd", r"(\w)\1{2}", r"İf", r"ΣΑΣ", r"\$\{x\}", r"(?<=x)foo(?!z)", r"(", r"x*", "[(]q[)]"]
    flags = ["m", "mi", "m", "mi", "m", "s", "i", "", "i", "", "m", "i", "i", "m", "", "m", "m", ""]
    texts = ["foo food xfooz xfoo", "alpha1 BETA2 alphabet9 123", "select  * from\nend\nabcd aaa", "a\nb sSK SSK SſK", "if İF σας ΣΑΣ", "${x} (q)", "", None, "foo food xfooz xfoo"]
    table = [rule_table.TableRule(f"r{i}", "antipattern", "critical", "c", "T", "", "", "", p, f) for i, (p, f) in enumerate(zip(patterns, flags, strict=True)) if p != "("]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "foo\nfoo"), (3, "foo\nfoo")], "id int, t string")
    got = sorted((r.id, r.rule_id, r.line, r.match) for r in rule_table.detect_table(df, "id", "t", table).collect())
    want = []
    for r in table:
        want += [(x.id, r.rule_id, x.line, x.match) for x in rules.detect(df, "id", "t", [rules.Rule(r.rule_id, r.pattern, "critical", "c", r.flags)]).collect()]
    assert got == sorted(want) and len(got) > 30
    assert rule_table.detect_table(df, "id", "t", []).count() == 0
    assert "Python" not in plan(rule_table.detect_table(df, "id", "t", table))


def test_rules_of_whole_words_meet_words_by_a_join(spark):
    assert [rule_table.whole_word(p) for p in (r"\bFoo_1\b", r"\bfoo", r"foo\b", r"\bfo+\b", r"\ba b\b", r"(?i)\bfoo\b", r"\b\b", r"\bЖук\b", r"\bé\b", "(")] == ["foo_1", None, None, None, None, None, None, "жук", None, None]
    patterns = [(r"\bfoo\b", "m"), (r"\bFOO\b", "mi"), (r"\bsk\b", "i"), (r"\bжук\b", "i"), (r"\bif\b", "i"), (r"\bss\b", "i"), (r"\ba_1\b", ""), (r"foo\d", "m"), (r"sk.x", "i"), (r"вод.", "i")]
    texts = ["foo Foo\r\nxfoo foo-foo\nfoo_ foo", "ſK SK sk", "Жук жУк\u0301 (жук)", "İF if IF ıf", "ß ss SS", "a_1 a_1. a_12", "foo\u0301 foo\u00b2 foo1", "ſK-x ᲀᲂᲁа", "", None]
    table = [rule_table.TableRule(f"r{i}", "antipattern", "critical", "c", "T", "", "", "", p, f) for i, (p, f) in enumerate(patterns)]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (0, "foo")], "id int, t string")
    got = sorted((r.id, r.rule_id, r.line, r.match) for r in rule_table.detect_table(df, "id", "t", table).collect())
    want = [(x.id, r.rule_id, x.line, x.match) for r in table for x in rules.detect(df, "id", "t", [rules.Rule(r.rule_id, r.pattern, "critical", "c", r.flags)]).collect()]
    assert got == sorted(want) and len(got) > 30
    said = plan(rule_table.detect_table(df, "id", "t", table[:7]))
    assert "hashpartitioning" not in said and "Window" not in said  # no text is searched once for each rule


def test_rule_files_of_the_usual_form(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "s").mkdir()
    (tmp_path / "a" / "1.yaml").write_text("id: no-star\ntitle: Star\nseverity: warning\ncategory: queries\napplicable_to: [module_form]\ndetect:\n  regex:\n    pattern: 'ВЫБРАТЬ\\s+\\*'\n    flags: mi\nrecommendation_for_llm: name the columns\n", encoding="utf-8")
    (tmp_path / "a" / "2.yaml").write_text("id: bad\ndetect:\n  regex:\n    pattern: '('\nseverity: critical\n")
    (tmp_path / "s" / "1.yaml").write_text("id: std.1\ntitle: No goto\nseverity: info\ncategory: style\nsource: {type: СТО, code: 2.1, url: http://x}\ndetect: {regex: {pattern: 'goto'}}\n", encoding="utf-8")
    (tmp_path / "s" / "2.yaml").write_text("id: std.2\ndetect: {}\n")
    schema = {"standard": {"type": "object", "required": ["title"], "properties": {"detect": {"type": "object"}}}}
    loaded, problems = stores.read_rules(spark, {"antipattern": f"{tmp_path}/a", "standard": f"{tmp_path}/s"}, schema)
    assert [r.problem for r in problems.collect()] == ["title is missing"]
    rows = {r["id"]: r for r in loaded.collect()}
    assert (rows["no-star"]["regex_pattern"], rows["no-star"]["flags"], rows["std.1"]["source_code"], rows["std.1"]["source_type"]) == (r"ВЫБРАТЬ\s+\*", "mi", "2.1", "СТО")
    code = spark.createDataFrame([(1, "x\nвыбрать  * из\ngoto a; goto b")], "id int, t string")
    found = lambda **k: [(r.rule_id, r.line, r.message, r.source.code) for r in rule_table.detect_table(code, "id", "t", rule_table.rule_rows(loaded, **k)).orderBy("rule_id", "line").collect()]
    assert found() == [("no-star", 2, "Star", ""), ("std.1", 3, "No goto", "2.1"), ("std.1", 3, "No goto", "2.1")]
    assert found(source_types=("БСП",)) == [("no-star", 2, "Star", "")] and found(severities=("info",)) == found(collections=("standard",)) and found(categories=("none",)) == []
    from weftwork.operators import lookups

    assert [(r.id, r.score) for r in lookups.search_kb(loaded, "2.1").collect()] == [("std.1", 0.7)]
    assert [(r.id, r.score) for r in lookups.search_kb(loaded, "columns").collect()] == [("no-star", 0.3)]
    assert [r.id for r in lookups.list_rules(loaded, "antipattern", applicable_to="module_form").collect()] == ["no-star"]


def test_schema_checks():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "pattern": "^x", "minLength": 2, "maxLength": 3}, "b": {"type": "array", "items": {"enum": ["p", 1]}, "minItems": 1}, "c": {"oneOf": [{"required": ["r"]}, {"required": ["s"]}]}, "d": {"type": "integer", "minimum": 0}}}
    say = lambda v: list(rule_schema.schema_problems(v, schema))
    assert say({"a": "xy", "b": ["p", 1], "c": {"r": 1}, "d": 3}) == []
    assert say([]) == ["is no object"] and say({}) == ["a is missing"]
    assert say({"a": "yyyy", "z": 1}) == ["z isn't known", "a: has 4 characters", "a: 'yyyy' doesn't match ^x"]
    assert say({"a": "xy", "b": [], "c": {"r": 1, "s": 2}, "d": True}) == ["b: has 0 items", "c: fits 2 of 2 forms, not one", "d: is no integer"]
    assert say({"a": "xy", "b": ["q"], "d": -1}) == ["b[0]: 'q' isn't allowed", "d: -1 is below 0"]


def test_xml_repairs():
    import xml.etree.ElementTree as ET

    cases = {
        "<a><b>x</b></a>": ("<a><b>x</b></a>", []),
        "<a><b>x</a>": ("<a><b>x</b></a>", ["closed elements: 1"]),
        "<a>x & y &amp; &nbsp; 1 < 2</a>": ("<a>x &amp; y &amp; &amp;nbsp; 1 &lt; 2</a>", ["escaped &: 2", "escaped <: 1"]),
        "<a></b></a><c/>tail": ("<a></a>", ["dropped ends: 1", "dropped after the root: 1", "dropped outside the root: 1"]),
        "<a x=1 y z='2' x=\"3\"><![CDATA[<q>": ('<a x="1" y="" z="2">&lt;q&gt;</a>', ["quoted attributes: 2", "dropped attributes: 1", "closed sections: 1", "closed at the end: 1"]),
        "<a><b": ("<a><b></b></a>", ["closed tags: 1", "closed at the end: 2"]),
        "<a>\x01<!-- c": ("<a></a>", ["removed characters: 1", "dropped comments: 1", "closed at the end: 1"]),
        "no markup": (None, ["dropped outside the root: 1"]),
        "": (None, []),
    }
    for broken, want in cases.items():
        assert xml_repair.repair(broken) == want
        if want[0]:
            ET.fromstring(want[0])
    rng = random.Random(6)
    whole = "<r>" + "".join(f"<p{i} k='{i}'>t &amp; u</p{i}><!--c--><![CDATA[d]]>" for i in range(20)) + "</r>"
    for _ in range(300):
        broken = list(whole)
        for _ in range(rng.randrange(1, 6)):
            i = rng.randrange(len(broken))
            broken[i : i + rng.randrange(3)] = rng.choice(["<", ">", "&", "'", '"', "/", "", "]]>", "<!--"])
        got = xml_repair.repair("".join(broken))[0]
        assert got is None or ET.fromstring(got) is not None
    began = time.time()
    assert xml_repair.repair("<a>" * 50_000)[1] == ["closed at the end: 50000"]
    xml_repair.repair("<a " + "x='" * 50_000)
    assert time.time() - began < 5


def test_broken_files_are_read(spark, tmp_path):
    (tmp_path / "Catalogs").mkdir()
    for name, xml in (("Whole", "<M><Catalog uuid='1'><Properties><Comment>c</Comment></Properties></Catalog></M>"), ("Cut", "<M><Catalog uuid='2'><Properties><v8:Comment>d & e</v8:Comm"), ("None", "")):
        (tmp_path / "Catalogs" / f"{name}.xml").write_text(xml)
    got = metadata.read_objects(spark, str(tmp_path), recover=True)
    assert {r.name: r.repairs for r in got.collect()} == {"Whole": None, "Cut": ["escaped &: 1", "dropped ends: 1", "closed at the end: 4"]}
    assert {(r.name, r.uuid, r.comment) for r in metadata.properties(got).collect()} == {("Whole", "1", "c"), ("Cut", "2", "d & e")}


def test_versions_and_lost_writers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    rows = lambda: sorted(map(tuple, versioned.read_table(spark, path).collect()))
    assert versioned.read_table(spark, path) is None
    base = spark.createDataFrame([(i, f"a{i}", 0) for i in range(40)], "k int, v string, t int")
    versioned.replace_table(base, path, ["k"], 8)
    before = versioned.current(spark, path)
    after = versioned.upsert_table(spark.createDataFrame([(3, "x", 2), (3, "y", 1), (99, "z", 0)], base.schema), path, ["t"])
    assert rows() == sorted([(i, f"a{i}", 0) for i in range(40) if i != 3] + [(3, "x", 2), (99, "z", 0)])
    same = [b for b in before.folders if before.folders[b] == after.folders[b]]
    assert len(same) >= 6  # other buckets aren't rewritten
    versioned.upsert_table(spark.createDataFrame([(5, "q", 7), (200, "w", 8)], base.schema), path, columns=["t"])
    assert (5, "a5", 7) in rows() and (200, "w", 8) in rows()
    assert versioned.delete_rows(spark, path, F.col("k") > 98)[1] == 2
    whole = rows()

    def lost(*_):
        raise KeyboardInterrupt  # the driver ends between the data and the manifest

    with monkeypatch.context() as m:
        m.setattr(versioned, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert_table(spark.createDataFrame([(1, "lost", 1)], base.schema), path)
    assert rows() == whole
    versioned.replace_table(versioned.read_table(spark, path).where("k < 10"), path, ["k"], 4)
    assert [r[0] for r in rows()] == list(range(10))


def test_two_writers_and_stale_locks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    monkeypatch.setattr(versioned, "PAUSE", 0)
    versioned.replace_table(spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), path, ["k"], 2)
    plain, other = versioned._commit, []

    def second(*args):
        if not other:  # another writer comes first
            other.append(1)
            monkeypatch.setattr(versioned, "_commit", plain)
            versioned.upsert_table(spark.createDataFrame([(1, 5)], "k int, v int"), path)
        return plain(*args)

    monkeypatch.setattr(versioned, "_commit", second)
    versioned.upsert_table(spark.createDataFrame([(2, 6), (3, 7)], "k int, v int"), path)
    assert sorted(map(tuple, versioned.read_table(spark, path).collect())) == [(1, 5), (2, 6), (3, 7)]
    at = versioned.current(spark, path)
    with pytest.raises(versioned.Conflict):
        versioned._commit(spark, path, at._replace(number=at.number - 1), at)
    (tmp_path / "t" / "manifests" / f"{at.number + 1:010d}.lock").write_text("")
    with pytest.raises(versioned.Conflict):
        versioned.upsert_table(spark.createDataFrame([(9, 9)], "k int, v int"), path)
    monkeypatch.setattr(versioned, "STALE", 0)
    time.sleep(0.1)
    assert versioned.upsert_table(spark.createDataFrame([(9, 9)], "k int, v int"), path).number == at.number + 1
    now = sorted(map(tuple, versioned.read_table(spark, path).collect()))
    assert versioned.vacuum(spark, path, older=-5) > 0
    assert sorted(map(tuple, versioned.read_table(spark, path).collect())) == now == [(1, 5), (2, 6), (3, 7), (9, 9)]


def test_regions_know_their_parents(spark):
    code = "#Область A\n#Область B\n#КонецОбласти\n#Область C\n#Область D\n#КонецОбласти\n#КонецОбласти\n#КонецОбласти\n#Region E\n#EndRegion\n#Region Open\n#Region In\n#EndRegion"
    found = builders.regions(text.lines(spark.createDataFrame([(1, code)], "f int, t string"), "f", "t"), "f").collect()
    assert {(r.name, r.start_line, r.end_line, r.depth, r.parent) for r in found} == {("A", 1, 8, 1, None), ("B", 2, 3, 2, "A"), ("C", 4, 7, 2, "A"), ("D", 5, 6, 3, "C"), ("E", 9, 10, 1, None), ("In", 12, 13, 2, None)}


def test_many_regions_in_one_file_take_linear_time(spark):
    took = []
    for n in (2000, 16_000):
        rows = spark.createDataFrame([(1, "\n".join(f"#Область R{i}\n#КонецОбласти" for i in range(n)))], "f int, t string")
        began = time.time()
        assert builders.regions(text.lines(rows, "f", "t"), "f").count() == n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 3


def test_export_in_a_comment_is_none(spark):
    code = "Процедура А() // Экспорт\nКонецПроцедуры\nПроцедура Б(С = \"//\") Экспорт // не экспорт\nКонецПроцедуры"
    rows = modules.methods(spark.createDataFrame([("p", code)], "path string, text string")).collect()
    assert {r.name: r.is_export for r in rows} == {"А": False, "Б": True}


def test_names_that_are_no_path():
    assert archives._unsafe(".") and archives._unsafe("") and archives._unsafe("a/../b") and not archives._unsafe("a/b.txt")


def test_secret_scan_of_a_long_run(spark):
    from weftwork.plans.registry import SECRETS

    df = spark.createDataFrame([(1, "a" * 400_000), (2, "x a.b@c.de y"), (3, "a@b@c.de")], "id int, t string")
    began = time.time()
    assert sorted(map(tuple, rules.secret_scan(df, "id", "t", SECRETS).collect())) == [(2, "mail", "***"), (3, "mail", "***")]
    assert time.time() - began < 15


def test_json_indexes_of_both_forms(spark, tmp_path):
    schema = "a int, b array<string>"
    assert stores.load_json(spark, str(tmp_path / "none"), schema) is None
    rows = spark.createDataFrame([(1, ["x\ny"]), (None, None)], schema)
    stores.save_json(rows, str(tmp_path / "i"))
    assert sorted(map(str, stores.load_json(spark, str(tmp_path / "i"), schema).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[{"a": 1, "b": ["q"]},\n {"a": 2}]')
    (tmp_path / "j" / "b.json").write_text('{"a": 3}\nno object\n')
    assert sorted((r.a, r.b) for r in stores.load_json(spark, str(tmp_path / "j"), schema).collect()) == [(1, ["q"]), (2, None), (3, None)]
    found = stores.present_paths(spark, {"i": str(tmp_path / "i"), "n": str(tmp_path / "n"), "s": "nostore://x/y"}).collect()
    assert {r.name: r.present for r in found} == {"i": True, "n": False, "s": False}


def test_module_records(spark):
    code = "#Область A\nПроцедура П(Б) Экспорт\nКонецПроцедуры\n#КонецОбласти\n"
    got = modules.module_records(spark.createDataFrame([("p", code, "k"), ("q", "", "k")], "path string, text string, kind string")).orderBy("path").collect()
    assert [(r.path, r.kind, r.line_count, [m.name for m in r.methods], [(a.name, a.start_line, a.end_line) for a in r.regions]) for r in got] == [("p", "k", 5, ["П"], [("A", 1, 4)]), ("q", "k", 1, [], [])]


def test_depth_of_a_view_is_bounded(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    for depth in (0, 6):
        with pytest.raises(ValueError, match="depth"):
            graph.dependency_view(edges, "a", "out", depth)


def test_iteration_log(spark):
    from weftwork.operators import findings

    rows = spark.createDataFrame([("p", 1, "a\nb", ["x"], None), ("p", 2, "", [], 3), ("p", 3, None, None, 0)], "plan_id string, number int, code string, failed_checks array<string>, edit_distance_vs_prev int")
    assert [tuple(r) for r in findings.iteration_log(rows).collect()] == [("p", 1, 2, 1, None), ("p", 2, 1, 0, 3), ("p", 3, None, 0, 0)]
