"""Graphs under changes, plan states, fuzzy names, impact sketches, text vectors, layers and roles on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import builders, graph, graph_upkeep, impact, names, roles, search, text_vectors
from weftwork.sources import modules, versioned
from weftwork.streaming import state

CODE = "path string, text string, module string, ref string"


def module(name, *methods, calls=()):
    body = "\n".join(f"Процедура {m}() Экспорт\n  {'; '.join(calls)};\nКонецПроцедуры" for m in methods)
    return (f"{name}.bsl", body, name, f"CommonModule.{name}")


def full(spark, rows):
    code = spark.createDataFrame(rows, CODE)
    exports = modules.methods(code).where("is_export").join(code.select("path", "module"), "path").select("module", F.col("name").alias("method"))
    return sorted(map(str, builders.call_graph(code, exports, builders.call_sites(code)).collect()))


def test_graph_follows_changes(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    rng = random.Random(8)
    calls = lambda: [rng.choice(["М1.Один(1)", "М2.Два()", "Новая.Х()", "Один()", "Три()", "М9.Х()"]) for _ in range(3)]
    before = [module(f"М{i}", "Один", "Два", calls=calls()) for i in range(6)] + [module("М9", "Х", calls=["М1.Один()"])]
    graph_upkeep.build_graph(spark.createDataFrame(before, CODE), root, 16)
    read = lambda: sorted(map(str, graph_upkeep.read_graph(spark, root).collect()))
    assert read() == full(spark, before)
    changed = [module("М1", "Три", calls=["М2.Два()", "Три()"]), module("Новая", "Х", calls=["М1.Три()"]), ("second.bsl", before[2][1].replace("Два", "Три"), "М2", "CommonModule.М2")]
    gone = spark.createDataFrame([("М9.bsl",)], "path string")
    after = [r for r in before if r[0] not in ("М1.bsl", "М9.bsl")] + changed
    was = {t: versioned.current(spark, f"{root}/{t}").folders for t in graph_upkeep.TABLES}
    delta = graph_upkeep.update_graph(spark.createDataFrame(changed, CODE), root, gone).collect()
    assert read() == full(spark, after) and {r["change"] for r in delta} == {"+", "-"}
    assert any(was["sites"].get(b) == f for b, f in versioned.current(spark, f"{root}/sites").folders.items())
    assert graph_upkeep.update_graph(spark.createDataFrame(changed, CODE), root, gone).count() == 0  # applied again
    assert read() == full(spark, after)


def test_lost_update_is_applied_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/g"
    before = [module("А", "Х", calls=["Б.У()"]), module("В", "Х")]
    graph_upkeep.build_graph(spark.createDataFrame(before, CODE), root, 2)
    new = spark.createDataFrame([module("Б", "У")], CODE)
    plain, n = graph_upkeep.replace_keys, []

    def lost(*args):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        return plain(*args)

    monkeypatch.setattr(graph_upkeep, "replace_keys", lost)
    with pytest.raises(KeyboardInterrupt):
        graph_upkeep.update_graph(new, root)
    graph_upkeep.update_graph(new, root)
    assert sorted(map(str, graph_upkeep.read_graph(spark, root).collect())) == full(spark, [*before, module("Б", "У")])


def test_graph_stream(spark, tmp_path):
    root, source = f"file://{tmp_path}/g", tmp_path / "in"
    source.mkdir()
    graph_upkeep.build_graph(spark.createDataFrame([module("А", "Х", calls=["Б.У()"])], CODE), root, 2)
    for i, rows in enumerate(([module("Б", "У")], [module("А", "Х", calls=["Б.У()", "Х()"])])):
        spark.createDataFrame(rows, CODE).coalesce(1).write.mode("append").parquet(str(source))
        graph_upkeep.update_stream(spark.readStream.schema(CODE).parquet(str(source)), root, f"{tmp_path}/c").awaitTermination()
        assert graph_upkeep.read_graph(spark, root).count() == i + 1 - (i == 1)


def test_states_survive_restarts_and_replays(spark, tmp_path):
    path, source = f"file://{tmp_path}/s", tmp_path / "ops"
    source.mkdir()
    ops = [("a", 1, "save", "1"), ("b", 1, "save", "2"), ("a", 3, "delete", None), ("a", 2, "save", "late"), ("c", 5, "save", "x"), ("c", 5, "save", "y"), (None, 1, "save", "n"), ("d", 4, "load", None), ("b", 2, "save", None)]
    df = lambda rows: spark.createDataFrame(rows, "plan_id string, at long, op string, state string").withColumn("at", F.timestamp_seconds("at"))
    assert state.load_state(spark, path, "a") is None
    for part in (ops[:2], ops[2:], ops):  # the third run repeats all
        df(part).coalesce(1).write.mode("append").parquet(str(source))
        state.state_stream(spark.readStream.schema(state.SCHEMA).parquet(str(source)), path, f"{tmp_path}/c").awaitTermination()
    assert {(r.plan_id, r.state) for r in state.states(spark, path).collect()} == {("b", None), ("c", "y")}
    assert state.load_state(spark, path, "c") == "y" and state.load_state(spark, path, "a") is None
    at = versioned.current(spark, path).number
    state.apply_operations(df(ops), path)
    assert {(r.plan_id, r.state) for r in state.states(spark, path).collect()} == {("b", None), ("c", "y")} and versioned.current(spark, path).number >= at
    assert state.expire(spark, path, F.timestamp_seconds(F.lit(4))) == 2  # a's tombstone and b
    assert [r.plan_id for r in state.states(spark, path).collect()] == ["c"]


def brute_trigrams(text):
    import re

    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(9)
    words = ["склад", "товар", "goods", "Номенклатура", "aaaa", "ab"]
    said = ["".join(rng.choice([w, w[:-1], w + "s", w[::-1]]) + rng.choice([" ", "", "_"]) for w in rng.choices(words, k=rng.randrange(1, 4))) for _ in range(120)] + ["", "__", "a", "А"]
    df = spark.createDataFrame([(s,) for s in said] + [(None,), (said[0],)], "n string")
    sets = {s: brute_trigrams(s) for s in set(said)}
    for least in (0.3, 0.5, 1.0):
        want = {}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                    want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        found = names.similar_names(df, "n", least)
        assert {(r.a, r.b): r.similarity for r in found.collect()} == pytest.approx(want)
    assert [r.n for r in names.similar_to(df.distinct(), "n", "n", "склад", 1).collect()][0].lower().strip(" _") in ("склад", "склад склад")
    assert names.similar_names(df.limit(0), "n").count() == 0
    with pytest.raises(ValueError):
        names.similar_names(df, "n", 0)


def test_impact_estimates_equal_closures_on_small_graphs(spark):
    rng = random.Random(10)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(110)] + [("x", "x"), (None, "x"), ("x", None), ("p", "q"), ("p", "q")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.impact for r in impact.impact_estimates(df, 10).collect()}
    back = {}
    for s, d in edges:
        if s and d:
            back.setdefault(d, set()).add(s)
    for node in {x for e in edges if None not in e for x in e}:
        seen, front = set(), {node}
        for _ in range(10):
            front = {s for f in front for s in back.get(f, ())} - seen
            seen |= front
        assert got[node] == len(seen)  # sketches of few entries are exact
    pairs = impact.checked_impact(df, impact.impact_estimates(df, 10), ["n1", "q"]).collect()
    assert all(r.impact == r.exact for r in pairs) and len(pairs) == 2
    line = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(6)], "src string, dst string")
    assert {r.settled for r in impact.impact_estimates(line, 3).collect()} == {False} and {r.settled for r in impact.impact_estimates(line, 9).collect()} == {True}
    many = spark.range(50_000).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("hub").alias("dst"))
    n = impact.impact_estimates(many, 2).where("node = 'hub'").first().impact
    assert abs(n - 50_000) < 0.06 * 50_000


def test_few_dependents_are_counted_exactly(spark):
    # These two names fall on one cell of a sketch, so that a sketch counts one of them.
    edges = [("order.2196111", "part"), ("order.2196113", "part"), ("part", "shop")]
    edges += [(f"a{i}", "hundred") for i in range(100)] + [(f"b{i}", "more") for i in range(101)] + [("more", "behind")]
    edges += [(f"c{i}", f"m{i % 3}") for i in range(120)] + [(f"m{i}", "joined") for i in range(3)]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.impact for r in impact.impact_estimates(df, 10).collect()}
    assert (got["part"], got["shop"], got["hundred"], got["m0"], got["c0"]) == (2, 3, 100, 40, 0)
    assert min(got["more"], got["behind"], got["joined"]) > 100
    assert impact.impact_estimates(df, 1).where("node = 'joined'").first().impact == 3


def test_text_vectors_find_near_texts(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"слово{i}" for i in range(200)] + [f"term{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(150)]
    rows += [(1000 + i, t.replace("term", "Term") + " extra") for i, t in rows[:20]] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    index = text_vectors.build_text_vectors(df, "id", "t", str(tmp_path / "v"), 128)
    vectors = index.vectors(spark)
    assert vectors.count() == len(rows) and vectors.where("vector is null").count() == 2
    sizes = vectors.where("vector is not null").select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in sizes)
    for i, t in rows[:20]:
        best = [r.id for r in search.vector_search(vectors, "vector", text_vectors.query_vector(spark, index, t), 2, "id").collect()]
        assert set(best) == {i, 1000 + i}
    assert text_vectors.query_vector(spark, index, " ... ") == []
    plan = vectors._jdf.queryExecution().toString() + text_vectors._vectors(text_vectors._counted(df, "id", "t"), spark.read.parquet(f"{index.path}/frequencies"), 3, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_layers_first_of_a_ref_wins(spark):
    rows = [(1, "a", "conf", "alpha", [1.0, 0.0]), (2, "a", "lib", "alpha", [1.0, 0.0]), (3, "b", "lib", "alpha", [0.9, 0.1]), (4, None, "lib", "alpha", [0.1, 0.9]), (5, None, "lib", "x", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id int, ref string, source_layer string, code_text string, embedding array<double>")
    got = search.layered_search(df, ["alpha"], [1.0, 0.0], [{"source_layer": "conf"}, {"source_layer": "lib"}], "ref", 4).collect()
    assert [(r.layer, r.chunk_id) for r in got] == [(0, 1), (1, 3), (1, 4), (1, 5)]
    with pytest.raises(ValueError):
        search.layered_search(df, [], [], [], "ref")


def test_roles_share_what_is_stated(spark):
    tools = roles.tool_table(spark)
    stated = roles.tool_table(spark, roles.SHARED)
    assert roles.sharing_problems(tools, stated).count() == 0
    assert {r.tool for r in roles.common_tools(tools, "GATHERER", "VALIDATOR").collect()} == {"kb.check_method_availability"}
    more = tools.union(spark.createDataFrame([("CODER", "git", "git.diff")], tools.schema))
    assert {tuple(r) for r in roles.sharing_problems(more, stated.where("role <> 'REVIEWER'").union(spark.createDataFrame([("X", "s", "s.t")], tools.schema))).collect()} == {
        ("CODER", "git.diff", "in the table, not stated"),
        ("COMMITTER", "git.diff", "in the table, not stated"),
        ("REVIEWER", "kb.check_antipatterns", "in the table, not stated"),
        ("X", "s.t", "stated, not in the table"),
    }
    calls = spark.createDataFrame([(1, "CODER", "git.diff"), (2, "COMMITTER", "git.diff"), (3, None, "x")], "id int, role string, tool string")
    assert sorted(r.id for r in roles.forbidden_calls(calls, tools).collect()) == [1, 3]
    assert set(roles.ROLES) >= {r.role for r in tools.collect()}


def test_closure_of_the_plain_graph_still_holds(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.impact_count(e, "c").first().impact == 2
