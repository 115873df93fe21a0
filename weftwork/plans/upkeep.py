"""Queries of what is kept up to date and of what needs no model: graphs under changes, plan states, fuzzy names, impact of all
objects, text vectors, layers of a search, and the tools of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import graph_upkeep as gu
from ..operators import impact as im
from ..operators import names as na
from ..operators import roles as ro
from ..operators import search as se
from ..operators import text_vectors as tv
from ..scratch import kept, new_path
from ..session import table
from ..streaming import state as ss
from .indexes import _CALLS, _modules
from .registry import _COS, _EDGES, _OVERLAP, TERMS, _vector, dependency_edges, query


@query(_CALLS + " SELECT * FROM calls")
def graph_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that was built when some modules had other texts, some weren't there and one was there that is gone now."""
    root = new_path(spark, "graph")
    code = _modules(spark, sf_dir)
    nation = F.regexp_extract("module", "([0-9]+)", 1).cast("int")
    old = code.where(nation % 10 != 2).withColumn("text", F.when(nation % 10 == 1, "Процедура Иная() Экспорт\n  Н3.М1();\nКонецПроцедуры").otherwise(F.col("text")))
    extra = spark.createDataFrame([("x.bsl", "Процедура П() Экспорт\n  П();\n  Н3.М1();\nКонецПроцедуры", "Лишний", "CommonModule.Лишний", "CommonModule")], code.schema)
    gu.build_graph(old.unionByName(extra), root, 4)
    gu.update_graph(code.where((nation % 10).isin(1, 2)), root, extra.select("path"))
    return gu.read_graph(spark, root)


@query("""
WITH o AS (SELECT 'u' || user_id AS plan_id, ts, event_type = 'error' AS gone, event_id::VARCHAR AS state FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY ts DESC, gone DESC, CASE WHEN gone THEN '' ELSE state END DESC) = 1)
SELECT plan_id, state FROM l WHERE NOT gone
""")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks save a user's plan and errors delete it; the later half comes first, then the earlier one, then all again."""
    path = new_path(spark, "states")
    e = table(spark, sf_dir, "events")
    ops = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("plan_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "click", ss.SAVE).when(F.col("event_type") == "error", ss.DELETE).alias("op"), F.col("event_id").cast("string").alias("state"), "event_id")
    middle = e.agg(F.avg("event_id")).first()[0] or 0
    for part in (ops.where(F.col("event_id") > middle), ops.where(F.col("event_id") <= middle), ops):
        ss.apply_operations(part.drop("event_id"), path)
    return ss.states(spark, path).select("plan_id", "state")


_NAMES = r"""n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS a FROM benchmark),
t AS (SELECT a, list_distinct(list_transform(range(1, length(a) + 2), lambda i: substr('  ' || a || ' ', i::INT, 3))) AS t FROM n)"""


@query(f"""
WITH {_NAMES}, p AS (SELECT x.a, y.a AS b, len(list_intersect(x.t, y.t)) AS c, len(x.t) + len(y.t) AS s FROM t x JOIN t y ON x.a < y.a)
SELECT a, b, round(c / (s - c)::DOUBLE, 9) AS similarity FROM p WHERE 10 * c >= 4 * (s - c)
""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of longer words of benchmark whose trigrams are alike by 0.4 or more."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("name"))
    return na.similar_names(words, "name", 0.4)


@query(r"""
WITH t AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS t FROM part),
q AS (SELECT ['  r', ' ri', 'rin', 'ing', 'ng '] AS q), s AS (SELECT p_partkey, round(len(list_intersect(t, q)) / (len(t) + 5 - len(list_intersect(t, q)))::DOUBLE, 9) AS similarity FROM t, q)
SELECT * FROM s WHERE similarity >= 0.05 ORDER BY similarity DESC, p_partkey LIMIT 10
""")
def fuzzy_name_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return na.similar_to(table(spark, sf_dir, "part"), "p_partkey", "p_name", "Ring", 10, 0.05)


@query(f"""
WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges),
r AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src), c AS (SELECT dst AS node, count(*) AS n FROM r GROUP BY 1)
SELECT node, CASE WHEN coalesce(n, 0) <= 100 THEN coalesce(n, 0) END AS impact, coalesce(n, 0) > 100 AS large FROM n LEFT JOIN c USING (node)
""")
def impact_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes depend on each node, directly or not; numbers over 100, whose estimates have an error, only as large."""
    found = im.impact_estimates(dependency_edges(spark, sf_dir), 10)
    return found.select("node", F.when(F.col("impact") <= 100, F.col("impact")).alias("impact"), (F.col("impact") > 100).alias("large"))


def text_vectors(spark: SparkSession, sf_dir: str) -> tv.TextVectors:
    docs = table(spark, sf_dir, "benchmark")
    path = kept(spark, "text-vectors", [f"{sf_dir}/benchmark.parquet"], lambda p: tv.build_text_vectors(docs, "item_id", "text", p, 64))
    return tv.TextVectors(path, "item_id", 64, docs.select("item_id").distinct().count())


_FEATURES = r"""w AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT id, list_concat(list_transform(w, lambda x: 'w:' || x), list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 2), lambda i: 'g:' || substr('  ' || x || ' ', i::INT, 3)))))) AS f FROM w),
c AS (SELECT id, unnest(f) AS f FROM g), tf AS (SELECT id, f, count(*) AS tf FROM c GROUP BY ALL), df AS (SELECT f, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT id, ('0x' || substr(md5(f), 1, 8))::BIGINT AS h, (1 + ln(tf)) * ln(1 + (SELECT count(DISTINCT item_id) FROM benchmark) / df::DOUBLE) AS x FROM tf JOIN df USING (f)),
d AS (SELECT id, h % 64 AS d, sum(CASE WHEN (h // 64) % 2 = 0 THEN x ELSE -x END) AS x FROM h GROUP BY ALL),
u AS (SELECT id, d, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM d)"""


@query(f"WITH {_FEATURES} SELECT id AS item_id, d::INT AS dimension, round(x, 6) AS value FROM u WHERE round(x, 6) <> 0")
def text_vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_vectors(spark, sf_dir).vectors(spark).select(F.col("id").alias("item_id"), F.posexplode("vector").alias("dimension", "value"))
    return rows.select("item_id", "dimension", F.round("value", 6).alias("value")).where("value <> 0")


@query(f"""
WITH {_FEATURES}, s AS (SELECT y.id, round(sum(x.x * y.x), 6) AS score FROM u x JOIN u y ON x.d = y.d WHERE x.id = (SELECT min(item_id) FROM benchmark) GROUP BY 1)
SELECT id AS item_id, score FROM s ORDER BY score DESC, id LIMIT 5
""")
def text_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar items from a text alone, that of the first item."""
    index = text_vectors(spark, sf_dir)
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()["text"]
    scored = se.scored_vectors(index.vectors(spark), "vector", tv.query_vector(spark, index, first)).select(F.col("id").alias("item_id"), F.round("score", 6).alias("score"))
    return se.top_k(scored, "score", 5, "item_id")


def _layer_sql(n: int, where: str) -> str:
    return f"""d{n} AS (SELECT doc_id, text, embedding, source FROM documents JOIN embeddings ON doc_id = vec_id WHERE {where}),
t{n} AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, {_OVERLAP} AS s FROM d{n}) WHERE s > 0 QUALIFY r <= 10),
v{n} AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, {_COS} AS s FROM d{n}) QUALIFY r <= 10),
u{n} AS (SELECT doc_id, r, 0 AS src FROM t{n} UNION ALL SELECT doc_id, r, 1 FROM v{n}),
f{n} AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(src * 1000 + r) AS first FROM u{n} GROUP BY 1 ORDER BY score DESC, first LIMIT 5),
r{n} AS (SELECT {n} AS layer, doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM f{n} JOIN d{n} USING (doc_id))"""


@query(f"""
WITH {_layer_sql(0, "lang = 'de'")}, {_layer_sql(1, "lang = 'en'")}, a AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY layer, rank) = 1)
SELECT layer, doc_id, source, score, rank FROM b ORDER BY layer, rank LIMIT 5
""")
def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German texts as the configuration and English ones as a library; of a source the first hit counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    got = se.layered_search(chunks, TERMS, _vector(spark, sf_dir, 0), [{"lang": "de"}, {"lang": "en"}], "source", 5, "doc_id", "text", "embedding")
    return got.select("layer", "doc_id", "source", "score", "rank")


@query("""
SELECT conv_id, turn AS number, len(string_split(text, chr(10)))::INT AS code_lines, len(list_filter(string_split(text, ' '), lambda w: w = 'the'))::INT AS failed_checks, length(role) AS edit_distance FROM conversations
""")
def iteration_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as tries of a task."""
    c = table(spark, sf_dir, "conversations")
    failed = F.filter(F.split("text", " "), lambda w: w == "the")
    rows = c.select("conv_id", F.col("turn").alias("number"), F.col("text").alias("code"), failed.alias("failed_checks"), F.length("role").cast("long").alias("edit_distance_vs_prev"))
    return fd.iteration_log(rows, ("conv_id",))


_ROLE_SQL = "CASE user_id % 3 WHEN 0 THEN 'VALIDATOR' WHEN 1 THEN 'REVIEWER' ELSE 'CODER' END"
_TOOL_SQL = "CASE event_type WHEN 'error' THEN 'kb.check_antipatterns' WHEN 'view' THEN 'bsl_ls.lint' ELSE 'kb.get_antipattern' END"


@query(f"""
WITH c AS (SELECT event_id, {_ROLE_SQL} AS role, {_TOOL_SQL} AS tool FROM events)
SELECT * FROM c WHERE NOT (role = 'VALIDATOR' AND tool IN ('kb.check_antipatterns', 'bsl_ls.lint') OR role = 'REVIEWER' AND tool IN ('kb.check_antipatterns', 'kb.get_antipattern'))
""")
def forbidden_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of tools by roles, some of which the role doesn't have."""
    calls = table(spark, sf_dir, "events").select("event_id", F.expr(_ROLE_SQL).alias("role"), F.expr(_TOOL_SQL).alias("tool"))
    return ro.forbidden_calls(calls, ro.tool_table(spark))


@query("SELECT 'Document.o' || o_orderkey AS src, 'Catalog.c' || CASE WHEN o_orderkey % 100 = 0 THEN -1 ELSE o_custkey END AS dst FROM orders WHERE o_orderkey % 100 <> 1")
def dependencies_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects that refer to their customers: a hundredth of them changes, another one goes."""
    root = new_path(spark, "dependencies")
    o = table(spark, sf_dir, "orders")

    def attributes(rows: DataFrame, customer) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        return rows.select(F.concat(F.lit("Documents/o"), key).alias("path"), F.lit("Document").alias("type"), F.concat(F.lit("o"), key).alias("name"), F.lit(None).cast("string").alias("tabular_section"), F.lit("К").alias("attr_name"), F.concat(F.lit("CatalogRef.c"), customer).alias("attr_type"))

    gu.update_dependencies(attributes(o, F.when(F.col("o_orderkey") % 100 == 0, "x").otherwise(F.col("o_custkey").cast("string"))), root)
    gone = o.where("o_orderkey % 100 = 1").select(F.concat(F.lit("Documents/o"), F.col("o_orderkey").cast("string")).alias("path"))
    gu.update_dependencies(attributes(o.where("o_orderkey % 100 = 0"), F.lit("_1")), root, gone)
    from ..sources.versioned import read_table

    return read_table(spark, f"{root}/dependencies").select("src", F.replace("dst", F.lit("c_1"), F.lit("c-1")).alias("dst"))
