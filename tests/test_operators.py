"""Operators on small hand-made tables: nulls, ties, cycles, Cyrillic text, empty input."""

import html
import re

import pytest
from pyspark.sql import functions as F

from weftwork.functions import refs
from weftwork.operators import findings, graph, rules, search, store, text


@pytest.mark.parametrize("pattern,flags", [(r"\bа\w+", "m"), (r"(\w)\1", "m"), (r"^x.*$", "m"), (r"a.b", "s"), (r"HELLO", "mi"), (r"\w+(?=\()", "m")])
def test_find_all_equals_finditer(spark, pattern, flags):
    texts = ["", "абв ёжик ааа\nxyz aa\r\nx2 hello f(1) g(2)", "a\nb\n\naa HeLLo xx", "нет", "x\nx\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.line, r.match) for r in rules.find_all(df, "id", "text", pattern, flags).collect()}
    on = sum({"m": re.M, "s": re.S, "i": re.I}[f] for f in flags)
    want = {(i, t.count("\n", 0, m.start()) + 1, m[0]) for i, t in enumerate(texts) for m in re.finditer(pattern, t, on)}
    assert got == want


def test_detect_skips_bad_patterns_and_filters(spark):
    df = spark.createDataFrame([(1, "foo bar"), (2, None)], "id int, text string")
    found = rules.detect(df, "id", "text", [rules.Rule("bad", "("), rules.Rule("foo", "foo", "critical"), rules.Rule("bar", "bar", "info")], severities=["critical"])
    assert [(r.id, r.rule_id) for r in found.collect()] == [(1, "foo")]
    assert rules.detect(df, "id", "text", []).count() == 0


def test_cosine_nulls_zero_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])], "id int, v array<double>")
    got = [(r.id, r.score) for r in search.vector_search(df, "v", [1.0, 0.0], 3, "id").collect()]
    assert got == [(1, 1.0), (4, 1.0), (3, 0.0)]
    assert search.similar(df, "id", "v", 99, 3).count() == 0


def test_rrf_prefers_rows_in_both_lists(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert [r.id for r in search.rrf([a, b], "id", 3).collect()] == [2, 1, 3]


def test_top_k_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = search.text_search(df, "text", ["a"], 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_null_filter(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, a string")
    assert [r.id for r in df.where(search.matches({"a": None})).collect()] == [1]
    assert df.where(search.matches({"a": None}, null_matches_null=False)).count() == 2


def test_closure_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("c", "c")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.closure(e, "a", 10).collect()}
    assert got == {("b", 1), ("c", 2), ("a", 3)}
    assert graph.closure(e, "zzz", 3).count() == 0
    assert graph.closure_edges(e, "a", 2).count() == 3
    with pytest.raises(ValueError):
        graph.neighbours(e, "a", "sideways")


def test_regions_siblings_and_nesting(spark):
    marks = spark.createDataFrame([("f", 1, True, "A"), ("f", 2, True, "B"), ("f", 3, False, ""), ("f", 4, True, "C"), ("f", 5, False, ""), ("f", 6, False, "")], "f string, line int, opens boolean, name string")
    got = {(r.name, r.start_line, r.end_line) for r in text.pair_regions(marks, "f", "line", "opens", "name").collect()}
    assert got == {("A", 1, 6), ("B", 2, 3), ("C", 4, 5)}


def test_comment_outside_quotes(spark):
    df = spark.createDataFrame([('a = "//x"; // tail',), ("no comment",), ('"open // in',)], "line string")
    assert [r[0] for r in df.select(text.strip_line_comment(F.col("line"))).collect()] == ['a = "//x"; ', "no comment", '"open // in']


def test_store_upsert_delete_fresh(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, store.upsert(base, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    rest, n = store.delete_where(base, F.col("v") == "a")
    assert rest.count() == 1 and n.first()[0] == 1
    one = spark.range(1)
    assert one.select(store.is_fresh(F.lit(2), F.lit(1)), store.is_fresh(F.lit(None), F.lit(1)), store.is_fresh(F.lit(1), F.lit(None))).first()[:] == (True, False, True)


def test_findings(spark):
    df = spark.createDataFrame([("1",), ("Warning",), ("4",), (None,)], "s string")
    assert [r[0] for r in df.select(findings.severity(F.col("s"))).collect()] == ["critical", "warning", "info", "info"]
    g = findings.gate(spark.createDataFrame([("warning",)], "severity string")).first()
    assert g.passed and g.n_failed == 1


def test_refs(spark):
    df = spark.createDataFrame([("Catalog.Goods.Main", "8.3.25"), ("none", "8.3"), (".x", "1.2.3.4")], "r string, v string")
    rows = df.select(refs.object_ref(F.col("r")).alias("r"), refs.version_struct(F.col("v")).alias("v")).collect()
    assert rows[0].r == ("Catalog", "Goods.Main") and rows[0].v == (8, 3, 25, 0)
    assert rows[1].r is None and rows[1].v is None and rows[2].r is None and rows[2].v.build == 4
    one = spark.range(1)
    assert one.select(refs.mask_dsn(F.lit("pg://u:secret@h/db"))).first()[0] == "pg://u:***@h/db"
    assert one.select(refs.diff_stat(F.lit("2 files changed, 10 insertions(+), 1 deletion(-)"))).first()[0] == (2, 10, 1)
    assert one.select(refs.artifact_ref(F.lit("p#1#2"))).first()[0] == ("p#1", 2)


def test_neighbour_distances_equal_brute_force(spark):
    """Gaps in ids, differences after character 100, Cyrillic and accented texts."""
    long = "x" * 150
    rows = [(9000, long + "b"), (1, long + "a"), (7, long + "ёж"), (8, "Straße"), (8300, "Strasse"), (8200, ""), (9001, None), (-5, "ü"), (None, "q")]

    def distance(a, b):
        if a is None or b is None:
            return None
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    order = sorted((r for r in rows if r[0] is not None))
    want = {a[0]: distance(a[1], b[1]) for a, b in zip(order, order[1:], strict=False)}
    got = text.neighbour_distances(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert len(got) == len(want) and {r.id: r.distance for r in got} == want


def test_whole_edit_distance_has_all_pairs(spark):
    from weftwork.plans.registry import QUERIES

    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert QUERIES["edit_distance"](spark, "/root/testdata/sf0.001").count() == items - 1


def test_calls_resolve_against_a_whole_table(spark):
    """Names that only documents from the 21st on have are found too."""
    from weftwork.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    words = lambda t: {w for r in t.collect() for w in re.findall("[a-z]+", (r.text or "").lower())}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('en', 'de')")
    late = words(docs) - words(docs.where("doc_id < 20")) - {"the", "of"}
    got = {r.method for r in QUERIES["calls_cross_module"](spark, sf).collect()}
    want = words(docs) & words(spark.read.parquet(f"{sf}/conversations.parquet")) - {"the", "of"}
    assert got == want and got & late


def test_unescape_equals_html_module(spark):
    texts = ["&amp;lt; &mdash;&#1040;&eacute; &#x41;&#X1F600; x & y && &unknown; &; &#; &#xZ &#0; &#128; &#xD800; &#99999999; &#x99999999;", "&nbsp;|&NotEqualTilde;|&copy &lt&gt;", "plain", "", None, "&" * 50]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(text.unescape(F.col("t"))).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_find_all_equals_finditer_with_repeated_ids(spark):
    texts = ["a1\nb22\n\nc3 d4\n", "a1\nb22\n\nc3 d4\n", "none", "", None, "x9" * 3]
    rows = spark.createDataFrame([(7, t) for t in texts], "id int, t string")
    got = sorted((r.line, r.pos, r.match) for r in rules.find_all(rows, "id", "t", "[a-z][0-9]+").collect())
    want = sorted((t[: m.start()].count("\n") + 1, k, m[0]) for t in texts if t for k, m in enumerate(re.finditer("[a-z][0-9]+", t)))
    assert got == want


def test_upsert_last_of_repeated_rows_wins(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 5)], "k int, v string, t int")
    assert sorted(tuple(r) for r in store.upsert(base, new, ["k"], ["t"]).collect()) == [(1, "x", 2), (2, "b", 0), (3, "z", 5)]


def test_dependency_view(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "b")], "src string, dst string")
    view = lambda *a: (lambda x: (sorted(map(tuple, x[0].collect())), *x[1:]))(graph.dependency_view(edges, *a))
    assert view(None, "both", 1, 2) == ([("a", "b"), ("a", "b")], 5, True)
    assert view("a", "out", 1) == ([("a", "b"), ("a", "b")], 2, False) and view("zz") == ([], 0, False)
    assert view("a", "both", 1) == ([("a", "b"), ("a", "b"), ("c", "a")], 3, False)
    assert view("c", "in", 2) == ([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c")], 4, False)
    with pytest.raises(ValueError):
        graph.dependency_view(edges, "a", "sideways")
    with pytest.raises(ValueError):
        graph.closure(edges, "a", 2, "sideways")


def test_edit_distance_of_neighbours(spark):
    rows = spark.createDataFrame([(1, "kitten"), (4, "sitting" * 60), (9, None), (10_000, "ж")], "item_id long, text string")
    got = {r.item_id: r.distance for r in text.neighbour_distances(rows, "item_id", "text").collect()}
    assert got == {1: 7 * 60 - 4, 4: None, 9: None}


def test_unavailable_calls(spark):
    code = spark.createDataFrame([(1, "x();\nПоказатьВопрос();\nНайти(1);\nПоказатьВопрос(2)"), (2, "Если (1) Закрыть ()")], "id int, t string")
    methods = spark.createDataFrame([("Найти", 0), ("Найти", 1), ("x", 0)], "name string, server int")
    got = sorted((r.id, r.code, r.line, r.severity) for r in rules.unavailable_calls(code, "id", "t", methods, "server", ["Если"]).collect())
    assert got == [(1, "METHOD-CONTEXT-x", 1, "critical"), (1, "METHOD-CONTEXT-ПоказатьВопрос", 2, "critical"), (2, "METHOD-CONTEXT-Закрыть", 1, "critical")]


def test_small_parsers(spark):
    rows = spark.createDataFrame([("a/b", "x/../y", "[1,2.5]"), ("a b", "x/y..z", "[1,x]"), ("o/n..m", "/abs", " [ -1e3 ]")], "r string, p string, v string")
    got = [tuple(r) for r in rows.select(refs.repository_valid(F.col("r")), refs.inside_root(F.col("p")), refs.vector_parse(F.col("v"))).collect()]
    assert got == [(True, False, [1.0, 2.5]), (False, True, None), (False, False, [-1000.0])]
    assert rows.limit(1).select(refs.vector_literal(F.array(F.lit(1.5), F.lit(-2.0)))).first()[0] == "[1.5,-2.0]"
