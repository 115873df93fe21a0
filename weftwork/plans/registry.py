"""Queries over the driver tables, with their DuckDB SQL. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import object_ref, version_struct
from ..operators import findings as fd
from ..operators import graph as gr
from ..operators import rules as ru
from ..operators import search as se
from ..operators import store as st
from ..operators import text as tx
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ("the", "tion", "ering", "worthless")
RULES = (
    ru.Rule("shout", r"[A-Z]{4,}!!", "critical", "style"),
    ru.Rule("symbols", r"[a-z]+[#$%&*]{3}", "warning", "style"),
    ru.Rule("address", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "critical", "privacy"),
    ru.Rule("short_line", r"^[A-Z][a-z]{1,3}\.$", "info", "layout"),
)
# The run before an at-sign begins where no such character stands before it and isn't given back: linear on long runs.
SECRETS = {"token": r"token = \"[0-9a-f]{40}\"", "mail": r"(?<![a-z.0-9])[a-z.0-9]++@[a-z0-9]++(?:\.[a-z]+)+"}
SECRETS_SQL = {"token": SECRETS["token"], "mail": r"[a-z.0-9]+@[a-z0-9]+(?:\.[a-z]+)+"}
SCOPES = ((0, 400, "outer"), (50, 200, "middle"), (100, 150, "inner"), (250, 300, "sibling"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


_OVERLAP = "round((" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS) + f") / {len(TERMS)}.0::DOUBLE, 9)"
_COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9)"


@query(f"""
WITH d AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en'),
t AS (SELECT doc_id, {_OVERLAP} AS s FROM d), tt AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM t WHERE s > 0 QUALIFY r <= 20),
v AS (SELECT doc_id, {_COS} AS s FROM d), vv AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM v QUALIFY r <= 20),
u AS (SELECT doc_id, r, 0 AS src FROM tt UNION ALL SELECT doc_id, r, 1 FROM vv),
f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf_score, min(src * 1000 + r) AS first FROM u GROUP BY 1)
SELECT doc_id, rrf_score FROM f ORDER BY rrf_score DESC, first LIMIT 10
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table is scored alone; only ids and scores meet, no text is shuffled."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = se.scored_texts(docs.select("doc_id", "text"), "text", TERMS).select("doc_id", "score").join(vectors.select("doc_id"), "doc_id", "left_semi")
    near = se.scored_vectors(vectors, "embedding", _vector(spark, sf_dir, 0)).select("doc_id", "score").join(docs.select("doc_id"), "doc_id", "left_semi")
    return se.hybrid(texts, near, "doc_id", 10)


@query(f"SELECT vec_id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.vector_search(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir, 0), 10, "vec_id").select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, {_COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(se.matches({"label": 3}))
    return se.vector_search(rows, "embedding", _vector(spark, sf_dir, 0), 10, "vec_id").select("vec_id", "label", "score")


@query(f"SELECT doc_id, {_OVERLAP} AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.text_search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TERMS, 10, "doc_id").select("doc_id", "score")


@query(f"""
SELECT vec_id, {_COS} AS score FROM embeddings WHERE vec_id <> 0 AND label <> (SELECT label FROM embeddings WHERE vec_id = 0)
ORDER BY score DESC, vec_id LIMIT 5
""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    own = rows.where("vec_id = 0").select("label").first()
    return se.similar(rows, "vec_id", "embedding", 0, 5, F.col("label") == (own[0] if own else -1)).select("vec_id", "score")


BM25_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'worthless')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
  + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10
"""


@query(BM25_SQL)
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = se.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ("worthless", "the"), 10)
    return got.select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL AND d.lang = 'de'")
def chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.where(se.matches({"quality": None, "lang": "de"})).select("doc_id", "lang")


def _tags(c: Column) -> Column:
    return F.split(c, " ")


@query("""
SELECT p_partkey, round(contains(lower(p_name), 'ring')::INT * 1.0 + contains(lower(p_brand), 'ring')::INT * 0.8
  + 0.5 * len(list_filter(string_split(p_type, ' '), lambda t: contains(lower(t), 'ring'))) + 0.3 * contains(lower(p_type), 'ring')::INT, 6)::DOUBLE AS score
FROM part WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20
""")
def kb_search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = se.field_score(F.col("p_name"), F.col("p_brand"), _tags(F.col("p_type")), [F.col("p_type")], F.lit(""), F.lit(""), "ring")
    return se.top_k(table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0"), "score", 20, "p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE list_contains(string_split(p_type, ' '), 'ECONOMY') AND p_size > 10")
def kb_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.array_contains(_tags(F.col("p_type")), "ECONOMY") & (F.col("p_size") > 10)).select("p_partkey", "p_brand")


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
  count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS n_urgent, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS n_high, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large FROM orders
""")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = [F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"]
    rest = [F.count_if(F.col("o_orderpriority").like("1%")).alias("n_urgent"), F.count_if(F.col("o_orderpriority").like("2%")).alias("n_high"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large")]
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), *status, *rest)


def _found_sql(rules: tuple[ru.Rule, ...]) -> str:
    one = """SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.category}' AS category,
      unnest(regexp_extract_all(text, '{p}')) AS match, unnest(range(1, 1 + len(regexp_extract_all(text, '{p}')))) AS k, string_split_regex(text, '{p}') AS parts FROM documents"""
    union = " UNION ALL ".join(one.format(r=r, p=f"(?{r.flags}){r.pattern}") for r in rules)
    return f"""WITH u AS ({union}),
f AS (SELECT doc_id, rule_id, severity, category, substr(match, 1, 100) AS match,
  (1 + len(list_aggregate(parts[:k], 'string_agg', '')) - len(replace(list_aggregate(parts[:k], 'string_agg', ''), chr(10), '')))::INT AS line FROM u)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.detect(table(spark, sf_dir, "documents"), "doc_id", "text", RULES)


@query(_found_sql(RULES) + " SELECT * FROM f")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query()
def rule_findings_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = ru.Rule("doubled", r"\b(\w{4,})\b(?=[ ,.]+\1\b)", "warning", "style")
    return ru.detect(table(spark, sf_dir, "documents"), "doc_id", "text", [rule])


@query(rf"""
WITH h AS (SELECT doc_id, regexp_extract(text, '{SECRETS_SQL["token"]}') AS a, regexp_extract(text, '{SECRETS_SQL["mail"]}') AS b FROM documents),
k AS (SELECT doc_id, CASE WHEN a <> '' THEN 'token' WHEN b <> '' THEN 'mail' END AS kind, CASE WHEN a <> '' THEN a ELSE b END AS s FROM h)
SELECT doc_id, kind, CASE WHEN len(s) > 12 THEN left(s, 8) || '***' || right(s, 4) ELSE '***' END AS masked FROM k WHERE kind IS NOT NULL
""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.secret_scan(table(spark, sf_dir, "documents"), "doc_id", "text", SECRETS)


_GATE = "count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info, count(*) FILTER (WHERE severity = 'critical') = 0 AS passed, count(*) FILTER (WHERE severity IN ('critical', 'warning')) AS n_failed"


@query(f"""
WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity FROM events)
SELECT user_id, {_GATE} FROM f GROUP BY 1
""")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "signup", "major").otherwise("hint")
    return fd.gate(table(spark, sf_dir, "events").select("user_id", fd.severity(level).alias("severity")), ["user_id"])


@query(_found_sql(RULES) + f" SELECT {_GATE} FROM f")
def findings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validators, each with a half of the rules, fanned in."""
    docs = table(spark, sf_dir, "documents")
    return fd.gate(fd.fan_in([ru.detect(docs, "doc_id", "text", RULES[:2]), ru.detect(docs, "doc_id", "text", RULES[2:])]))


@query("""
SELECT event_id, event_type, CASE event_type WHEN 'click' THEN true WHEN 'error' THEN false WHEN 'signup' THEN true WHEN 'view' THEN false ELSE true END AS available,
  CASE event_type WHEN 'click' THEN 'table' WHEN 'error' THEN 'table' WHEN 'signup' THEN 'list' WHEN 'view' THEN 'list' ELSE 'unknown' END AS reason FROM events
""")
def availability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = spark.createDataFrame([("click", 1), ("error", 0)], "name string, server int")
    calls = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ru.availability(calls, "event_type", methods, ["signup"], ["view"], "server")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.first_wins(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


_EDGES = """edges AS (
  SELECT 'customer.' || c_custkey AS src, 'nation.' || c_nationkey AS dst FROM customer UNION ALL SELECT 'supplier.' || s_suppkey, 'nation.' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation.' || n_nationkey, 'region.' || n_regionkey FROM nation UNION ALL SELECT 'order.' || o_orderkey, 'customer.' || o_custkey FROM orders
  UNION ALL SELECT 'order.' || l_orderkey, 'part.' || l_partkey FROM lineitem UNION ALL SELECT 'order.' || l_orderkey, 'supplier.' || l_suppkey FROM lineitem)"""


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey"), ("lineitem", "order", "l_orderkey", "part", "l_partkey"), ("lineitem", "order", "l_orderkey", "supplier", "l_suppkey"))
    out = None
    for t, a, ka, b, kb in parts:
        e = table(spark, sf_dir, t).select(F.concat(F.lit(f"{a}."), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(f"{b}."), F.col(kb).cast("string")).alias("dst"))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE src = 'order.1'")
def dep_edges_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbours(dependency_edges(spark, sf_dir), "order.1", "out")


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE dst = 'nation.3'")
def dep_edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbours(dependency_edges(spark, sf_dir), "nation.3", "in")


def _walk(start: str, depth: int, a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, steps AS (SELECT DISTINCT {a} AS x, {b} AS y FROM edges),
walk AS (SELECT y AS node, 1 AS depth FROM steps WHERE x = '{start}' UNION SELECT y, depth + 1 FROM walk JOIN steps ON x = node WHERE depth < {depth}),
closed AS (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1)"""


@query(_walk("nation.3", 2, "dst", "src") + " SELECT * FROM closed")
def dep_closure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over edges that aren't indexed."""
    return gr.closure(dependency_edges(spark, sf_dir), "nation.3", 2, "in")


@query(f"WITH {_EDGES}, e AS (SELECT unnest([src, dst]) AS node FROM edges) SELECT count(DISTINCT node) AS nodes, count(*) // 2 AS edges, round(count(*) / count(DISTINCT node)::DOUBLE, 6) AS avg_degree FROM e")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.graph_stats(dependency_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, e AS (SELECT unnest([src, dst]) AS node FROM edges) SELECT node, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.hubs(dependency_edges(spark, sf_dir), 10)


_STEPS = "calls AS (SELECT event_type AS src, lead(event_type) OVER w AS dst, 'u' || user_id % 5 AS src_method, 'u' || lead(user_id) OVER w % 5 AS dst_method FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    method = F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), method.alias("src_method"), F.lead(method).over(w).alias("dst_method"))


@query(f"WITH {_STEPS} SELECT count(*) AS total, count(DISTINCT src) AS callers, count(DISTINCT dst) AS callees FROM calls WHERE (src = 'error' OR dst = 'error') AND (src_method = 'u1' OR dst_method = 'u1')")
def call_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.call_stats(gr.filter_calls(_transitions(spark, sf_dir), "error", "u1"))


@query(r"""
WITH c AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS method, lang AS module FROM documents),
e AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS method FROM conversations)
SELECT module, method, count(*) AS n FROM c WHERE module IN ('en', 'de') AND method NOT IN ('the', 'of') AND method IN (SELECT method FROM e) GROUP BY 1, 2
""")
def calls_cross_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of both modules are all words of conversations; no word of part occurs in these documents."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("method")
    calls = table(spark, sf_dir, "documents").select(words, F.col("lang").alias("module"))
    modules = spark.createDataFrame([("en",), ("de",)], "module string")
    excluded = spark.createDataFrame([("the",), ("of",)], "method string")
    exports = table(spark, sf_dir, "conversations").select(words).distinct().crossJoin(modules)
    return gr.resolve_calls(calls, modules, exports, excluded).groupBy("module", "method").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '<module>') AS scope FROM conversations")
def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return tx.enclosing(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "scope")


_SCOPE_ROWS = ", ".join(f"({s}, {e}, '{n}')" for s, e, n in SCOPES)


@query(f"""
WITH r(s, e, n) AS (VALUES {_SCOPE_ROWS}), f AS (SELECT DISTINCT user_id FROM events), i AS (SELECT event_id, user_id, event_id % 500 AS line FROM events)
SELECT event_id, i.user_id, line, arg_max(n, s) AS region FROM i LEFT JOIN (SELECT user_id, s + user_id % 10 AS s, e, n FROM f, r) x ON x.user_id = i.user_id AND line BETWEEN s AND e GROUP BY 1, 2, 3
""")
def region_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files: each has its own regions."""
    events = table(spark, sf_dir, "events")
    scope = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n")) for a, b, n in SCOPES]))
    regions = events.select("user_id").distinct().select("user_id", scope.alias("x")).select("user_id", (F.col("x.a") + F.col("user_id") % 10).alias("s"), F.col("x.b").alias("e"), F.col("x.n").alias("n"))
    items = events.select("event_id", "user_id", (F.col("event_id") % 500).alias("line"))
    return tx.assign_regions(items, regions, "user_id", "line", ("n", "s", "e"))


@query("SELECT p_brand AS module, count(*) AS n_methods, string_agg(p_name || ':' || p_partkey, ',' ORDER BY p_partkey) AS methods FROM part WHERE p_size > 10 GROUP BY 1")
def api_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("n_methods"), F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("m"))
    return rows.select("module", "n_methods", F.array_join(F.transform("m", lambda x: F.concat(x["p_name"], F.lit(":"), x["p_partkey"].cast("string"))), ",").alias("methods"))


@query("SELECT coalesce(lang, '<total>') AS lang, coalesce(source, '<total>') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def metadata_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("<total>")).alias("lang"), F.coalesce("source", F.lit("<total>")).alias("source"), "n")


@query("SELECT json_extract_string(props, '$.k') AS code, count(*) AS n FROM events GROUP BY 1")
def diag_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.count_by_code(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("code")))


#: References that the pages of the driver hold; the operator knows all, which a test holds against Python's html module.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))


def _strip_sql(c: str) -> str:
    for name, char in _ENTITIES:
        c = f"replace({c}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    c = rf"regexp_replace({c}, '&amp(?:;|([^A-Za-z0-9;]|$))', '&\1', 'g')"  # also without its semicolon, at the end of a cut title
    return rf"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D\x{{A0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'is')) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line_no FROM documents"


@query(f"WITH l AS ({_LINES}) SELECT source || '_' || doc_id || '_' || (line_no - 1) AS chunk_id, doc_id, (line_no - 1)::INT AS pos, line AS chunk FROM l WHERE trim(line) <> ''")
def chunk_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("source"))


@query(f"WITH l AS ({_LINES}) SELECT doc_id, line_no::INT AS line_no, line FROM l")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, string_agg(regexp_extract(line, '^((?:[^\"|]|\"[^\"]*(?:\"|$))*)', 1), chr(10) ORDER BY line_no) AS text FROM (" + _LINES + ") GROUP BY 1")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.transform(F.split("text", "\n", -1), lambda x: tx.strip_line_comment(x, "|"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cut, "\n").alias("text"))


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.first_wins(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's first event is the base, all events are new rows, many to a user; the last wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    base = st.first_wins(rows, ["user_id"], ["event_id"])
    return st.upsert(base, rows, ["user_id"], ["event_id"])


@query("SELECT doc_id, source, (SELECT count(*) FROM documents WHERE source = 'src5') AS deleted FROM documents WHERE source <> 'src5' OR source IS NULL")
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, count = st.delete_where(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source") == "src5")
    return rest.withColumn("deleted", F.lit(count.first()[0]))


@query("""
WITH e AS (SELECT event_type AS name, max(ts) AS t FROM events GROUP BY 1), o AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT name, e.t >= o.t AS fresh FROM e, o
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("t")).select("name", st.is_fresh(F.col("t"), F.lit(latest).cast("timestamp_ntz")).alias("fresh"))


@query("SELECT n_name || ':' || r_name AS key, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name || ':' || r_name IN (SELECT n_name || ':' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7)")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(st.registry_key(F.col("n_name"), F.col("r_name")).alias("key"), "n_nationkey")
    wanted = both.where("n_nationkey = 7").first()
    return both.where(F.col("key") == (wanted["key"] if wanted else ""))


@query("""
SELECT l.doc_id, CASE WHEN quality = 1 THEN 'review' WHEN doc_id % 5 >= 3 THEN 'escalate' ELSE 'retry' END AS after_validate,
  CASE WHEN toxic = 0 THEN 'commit' WHEN doc_id % 5 >= 3 THEN 'escalate' ELSE 'retry' END AS after_review,
  CASE WHEN doc_id % 5 >= 3 THEN 'escalate' ELSE 'code' END AS after_retry, CASE WHEN doc_id % 3 > 0 THEN 'next_subtask' ELSE 'done' END AS after_commit,
  CASE WHEN doc_id % 5 >= 3 THEN 'max_iterations' WHEN doc_id % 7 >= 3 THEN 'too_many_criticals' ELSE 'tool_error' END AS reason,
  least(0.5 * pow(2, doc_id % 5), 4.0) AS delay FROM labels l
""")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("doc_id") % 5
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        fd.route_after_validate(F.col("quality") == 1, turn).alias("after_validate"),
        fd.route_after_review(F.col("toxic") == 0, turn).alias("after_review"),
        fd.route_after_retry(turn).alias("after_retry"),
        fd.route_after_commit(F.col("doc_id") % 3).alias("after_commit"),
        fd.escalation_reason(turn, F.col("doc_id") % 7).alias("reason"),
        fd.backoff(turn + 1, 0.5, 4.0).alias("delay"),
    )


@query(_found_sql(RULES) + " SELECT doc_id, string_agg('[' || severity || '] ' || rule_id || ' (' || line || '): ' || match, chr(10) ORDER BY rule_id, line, match) AS prompt FROM f WHERE severity IN ('critical', 'warning') GROUP BY 1")
def retry_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).withColumnRenamed("rule_id", "code").withColumnRenamed("match", "message")
    return fd.retry_text(rows, "doc_id", ["code", "line", "message"])


@query()
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.neighbour_distances(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT page_id, split_part(substr(url, strpos(url, '://') + 3), '.', 1) AS type, substr(substr(url, strpos(url, '://') + 3), strpos(substr(url, strpos(url, '://') + 3), '.') + 1) AS name FROM pages")
def ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = object_ref(F.substring_index("url", "://", -1))
    return table(spark, sf_dir, "pages").select("page_id", ref["type"].alias("type"), ref["name"].alias("name"))


@query("SELECT p_partkey, (8 * 10000 + p_size * 100 + p_partkey % 7) >= 82003 AS new_enough FROM part")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(".", F.lit("8"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", (version_struct(text) >= version_struct(F.lit("8.20.3"))).alias("new_enough"))
