"""Queries over files that are composed from the driver tables and written to the shared folder: rule files in their usual
form, dumps of metadata and modules (some broken), and tables that change by versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import indexing
from ..functions import refs as re
from ..operators import builders as bu
from ..operators import lookups as lo
from ..operators import rule_table as rt
from ..operators import rules as ru
from ..operators import text as tx
from ..scratch import kept, new_path
from ..session import table
from ..sources import archives as ar
from ..sources import helpbook as hb
from ..sources import metadata as md
from ..sources import stores as so
from ..sources import versioned as ve
from ..sources import xml_repair as xr
from .indexes import _M, _RULES_SQL, _modules, _objects, _rules
from .registry import RULES, _found_sql, query

#: Words of `benchmark` from which rules are made.
WORD = "[a-z]{5,}"


def rule_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of rule files: an antipattern for each longer word of benchmark, and the rules of `registry.RULES` as
    standards. Each is a JSON file of its own."""

    def build(path: str) -> None:
        text = F.lower("text")
        words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("w")).distinct()
        regex = F.struct(F.struct(F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"), F.lit("mi").alias("flags")).alias("regex"))
        level = F.when(F.length("w") % 3 == 0, "critical").when(F.length("w") % 3 == 1, "warning").otherwise("info")
        rows = words.select(F.concat(F.lit("antipatterns/"), "w", F.lit(".json")).alias("entry"), F.struct(F.concat(F.lit("w-"), "w").alias("id"), F.concat(F.lit("Word "), "w").alias("title"), level.alias("severity"), F.lit("style").alias("category"), regex.alias("detect")).alias("rule"))
        own = spark.createDataFrame([(f"standards/{r.rule_id}.json", (r.rule_id, f"Rule {r.rule_id}", r.severity, r.category, ((r.pattern, r.flags),), ("internal", "2.1", "http://x"))) for r in RULES], "entry string, rule struct<id:string, title:string, severity:string, category:string, detect:struct<regex:struct<pattern:string,flags:string>>, source:struct<type:string,code:string,url:string>>")
        said = rows.select("entry", F.to_json("rule").alias("said")).unionByName(own.select("entry", F.to_json("rule").alias("said")))
        ar.unpack(said.select("entry", F.encode("said", "UTF-8").alias("content"), F.lit(None).cast("string").alias("problem")), path).count()

    return kept(spark, "rules", [f"{sf_dir}/benchmark.parquet"], build)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rule_files(spark, sf_dir)
    return so.read_rules(spark, {"antipattern": f"{path}/antipatterns", "standard": f"{path}/standards"})[0]


_WORD_RULES = f"words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM benchmark)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10)))))::INT AS n FROM documents)"


@query(rf"""
WITH {_WORD_RULES}, {_LINES}, t AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')) AS said FROM l)
SELECT doc_id, 'w-' || w AS rule_id, CASE length(w) % 3 WHEN 0 THEN 'critical' ELSE 'warning' END AS severity, n AS line, 'Word ' || w AS message, substr(said, 1, 100) AS match FROM t JOIN words ON lower(said) = w WHERE length(w) % 3 <> 2
""")
def rule_table_antipatterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All word rules from files, critical and warning ones as they stand, in one scan of the texts."""
    rules = rt.rule_rows(_loaded(spark, sf_dir), ("antipattern",))
    return rt.detect_table(table(spark, sf_dir, "documents"), "doc_id", "text", rules).select("doc_id", "rule_id", "severity", "line", "message", "match")


@query(_found_sql(RULES) + " SELECT doc_id, rule_id, severity, category, 'internal' AS source_type, '2.1' AS source_code, 'http://x' AS url, line, match FROM f")
def rule_table_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without a literal among them, which run on every text."""
    rules = rt.rule_rows(_loaded(spark, sf_dir), ("standard",), source_types=("internal",))
    found = rt.detect_table(table(spark, sf_dir, "documents"), "doc_id", "text", rules)
    return found.select("doc_id", "rule_id", "severity", "category", F.col("source.type").alias("source_type"), F.col("source.code").alias("source_code"), F.col("source.url").alias("url"), "line", "match")


@query(f"WITH {_WORD_RULES} SELECT 'w-' || w AS id, 'Word ' || w AS title, '\\b' || w || '\\b' AS regex_pattern FROM words WHERE length(w) % 3 = 0")
def rule_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.list_rules(_loaded(spark, sf_dir), "antipattern", "style", "critical").select("id", "title", "regex_pattern")


#: A schema of rule files for the query below.
SCHEMA = {"type": "object", "required": ["id", "detect"], "properties": {"title": {"type": "string", "minLength": 11}, "detect": {"type": "object", "required": ["regex"]}}}


@query(f"WITH {_WORD_RULES} SELECT 'w-' || w AS id, CASE WHEN length(w) < 6 THEN 'title: has 10 characters' END AS problem FROM words")
def rule_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that don't fit a schema are told with their fault."""
    path = rule_files(spark, sf_dir)
    rules, problems = so.read_rules(spark, {"antipattern": f"{path}/antipatterns"}, {"antipattern": SCHEMA})
    word = F.concat(F.lit("w-"), F.regexp_extract("path", r"([a-z]+)\.json$", 1))
    return rules.select("id", F.lit(None).cast("string").alias("problem")).unionByName(problems.select(word.alias("id"), "problem"))


def _secret(key: Column) -> Column:
    """A secret of each fixed shape in turn, made of a key, and one that is a character short."""
    digits = lambda n: F.lpad(key.cast("string"), n, "0")
    kinds = [
        F.concat(F.lit("github_pat_"), digits(22)), F.concat(F.lit("ghp_"), digits(36)), F.concat(F.lit("AKIA"), digits(16)), F.lit("-----BEGIN RSA PRIVATE KEY-----"),
        F.concat(F.lit("bearer  "), digits(20)), F.concat(F.lit("xoxb-"), digits(10)), F.concat(F.lit("ghp_"), digits(35)),
    ]
    return F.element_at(F.array(*kinds), (F.pmod(key, F.lit(7)) + 1).cast("int"))


@query("""
WITH k AS (SELECT c_custkey, c_custkey % 7 AS m, CASE c_custkey % 7 WHEN 0 THEN 'github_pat_' || lpad(c_custkey::VARCHAR, 22, '0') WHEN 1 THEN 'ghp_' || lpad(c_custkey::VARCHAR, 36, '0')
  WHEN 2 THEN 'AKIA' || lpad(c_custkey::VARCHAR, 16, '0') WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 4 THEN 'bearer  ' || lpad(c_custkey::VARCHAR, 20, '0') WHEN 5 THEN 'xoxb-' || lpad(c_custkey::VARCHAR, 10, '0') END AS s FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN 'fine-grained token' WHEN 1 THEN 'classic token' WHEN 2 THEN 'access key' WHEN 3 THEN 'private key' WHEN 4 THEN 'bearer token' ELSE 'chat token' END AS kind,
  left(s, 8) || '***' || right(s, 4) AS masked FROM k WHERE m < 6
""")
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret of each fixed shape in turn, and one that is a character short, inside a text for each customer."""
    text = F.concat(F.lit("key: "), _secret(F.col("c_custkey")), F.lit("\n"), "c_name")
    return ru.secret_scan(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
a AS (SELECT user_id, 'R' || event_id AS name, (4 * i + 1)::INT AS start_line, (4 * i + 4)::INT AS end_line, 1 AS depth, NULL AS parent FROM r)
SELECT * FROM a UNION ALL SELECT user_id, 'I' || substr(name, 2), start_line + 1, end_line - 1, 2, name FROM a
""")
def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings, each with a region inside: four lines for each event of a user."""
    ids = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    key = lambda x: x.cast("string")
    text = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("#Область R"), key(x), F.lit("\n #region I"), key(x), F.lit("\n#endregion\n  #КонецОбласти"))), "\n")
    found = bu.regions(tx.lines(ids.select("user_id", text.alias("text")), "user_id", "text"), "user_id")
    return found.select("user_id", "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("depth").cast("int").alias("depth"), "parent")


def _broken(key: Column, name: Column) -> Column:
    """XML of a catalog, whole or broken in one of three ways."""
    attr = "<Attribute><Properties><Name>A</Name><Type><Type>cfg:CatalogRef.G</Type></Type></Properties></Attribute>"
    head = F.concat(F.lit("<MetaDataObject><Catalog uuid='u"), key.cast("string"), F.lit("'><Properties><Comment>"))
    tail = F.lit(f"</Comment></Properties><ChildObjects>{attr}</ChildObjects></Catalog></MetaDataObject>")
    whole = F.concat(head, name, tail)
    forms = [
        whole,
        F.concat(head, name, F.lit(f"</Comment></Properties><ChildObjects>{attr}<Attribute><Prop")),
        F.concat(head, name, F.lit(f"</Comment></Other></Properties><ChildObjects><Deep>{attr}</ChildObjects></Catalog></MetaDataObject>")),
        F.concat(F.replace(head, F.lit("'"), F.lit("")), name, F.lit(" & <1"), tail),
    ]
    return F.element_at(F.array(*forms), (F.pmod(key, F.lit(4)) + 1).cast("int"))


@query("""
SELECT s_suppkey, 'u' || s_suppkey AS uuid, s_name || CASE s_suppkey % 4 WHEN 3 THEN ' & <1' ELSE '' END AS comment,
  CASE WHEN s_suppkey % 4 = 2 THEN NULL ELSE 'A' END AS attr_name, CASE s_suppkey % 4 WHEN 1 THEN 'closed tags: 1, closed at the end: 5' WHEN 2 THEN 'dropped ends: 1, closed elements: 1' WHEN 3 THEN 'quoted attributes: 1, escaped &: 1, escaped <: 1' END AS repairs
FROM supplier
""")
def xml_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated, unbalanced and badly escaped files keep their properties, and attributes where these stand in their place."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.lit("Catalog").alias("type"), F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").cast("string").alias("path"), _broken(F.col("s_suppkey"), F.col("s_name")).alias("xml"))
    mended = xr.repaired(rows.withColumn("well_formed", md.well_formed(F.col("xml"))))
    own = md.properties(mended).select("name", "uuid", "comment").join(mended.select("name", F.array_join("repairs", ", ").alias("repairs")), "name")
    return own.join(md.attributes(mended).select("name", "attr_name"), "name", "left").withColumn("s_suppkey", F.col("name").cast("long")).drop("name")


def dump(spark: SparkSession, sf_dir: str) -> str:
    """A dump in the shared folder: a file for each object and module that `indexes` composes of nations and suppliers; every
    fourth nation's objects lack their last ten characters."""

    def build(path: str) -> None:
        objects = _objects(spark, sf_dir)
        cut = F.when(F.regexp_extract("name", "([0-9]+)$", 1).cast("int") % 4 == 3, F.left("xml", F.length("xml") - 10)).otherwise(F.col("xml"))
        files = objects.select(F.col("path").alias("entry"), F.encode(cut, "UTF-8").alias("content")).unionByName(_modules(spark, sf_dir).select(F.col("path").alias("entry"), F.encode("text", "UTF-8").alias("content")))
        ar.unpack(files.withColumn("problem", F.lit(None).cast("string")), path).count()

    return kept(spark, "dump", [f"{sf_dir}/{t}.parquet" for t in ("nation", "supplier")], build)


_KINDS = "(VALUES ('Catalog'), ('Document'), ('CommonModule'), ('Subsystem')) v(t)"


@query(f"SELECT t AS type, t[1] || n_nationkey AS name, 'u-' || n_nationkey AS uuid, n_name AS synonym, n_nationkey % 4 = 3 AS mended FROM nation, {_KINDS}")
def dump_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, _ = indexing.read_sources(spark, dump(spark, sf_dir))
    return md.properties(objects).join(objects.select("type", "name", F.col("repairs").isNotNull().alias("mended")), ["type", "name"]).select("type", "name", "uuid", "synonym", "mended")


@query(f"WITH {_M} SELECT 'Н' || n AS module, ref, 'CommonModule' AS kind, count(*) AS methods FROM m GROUP BY n, ref")
def dump_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import modules as mo

    _, code = indexing.read_sources(spark, dump(spark, sf_dir))
    return mo.methods(code).groupBy("path").agg(F.count("*").alias("methods")).join(code.select("path", "module", "ref", "kind"), "path").drop("path")


@query(f"WITH {_M} SELECT ref, kind, (4 * count(*) + 2)::INT AS line_count, string_agg('М' || k, ',' ORDER BY k) AS methods, 'Все:1:' || 4 * count(*) + 2 AS regions FROM (SELECT *, 'CommonModule' AS kind FROM m) GROUP BY ref, kind")
def module_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a module, whose methods stand in one region."""
    from ..sources import modules as mo

    code = _modules(spark, sf_dir).withColumn("text", F.concat(F.lit("#Область Все\n"), "text", F.lit("\n#КонецОбласти")))
    names = F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods")
    areas = F.array_join(F.transform("regions", lambda r: F.concat_ws(":", r["name"], r["start_line"].cast("string"), r["end_line"].cast("string"))), ",").alias("regions")
    return mo.module_records(code).select("ref", "kind", "line_count", names, areas)


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n, (p_partkey % 5)::VARCHAR AS b FROM part)
SELECT 'b' || b || '.hbk' AS book, CASE WHEN k % 2 = 0 THEN 'p' || k || '.html' ELSE 'page' || k END AS entry, n AS title FROM p
""")
def help_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five books of the parts' pages, some without a suffix, with other files between them; two books have lost their
    directory, so that their entries are found by their local headers."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")

    def build(path: str) -> None:
        name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p"), key, F.lit(".html"))).otherwise(F.concat(F.lit("page"), key))
        page = F.struct(name.alias("name"), F.concat(F.lit("<html><title>"), "p_name", F.lit("</title></html>")).alias("text"))
        other = F.struct(F.concat(F.lit("x"), key, F.lit(".txt")).alias("name"), F.lit("no page").alias("text"))
        book = F.concat(F.lit("b"), (F.col("p_partkey") % 5).cast("string"), F.lit(".hbk"))
        each = p.select(book.alias("archive"), F.explode(F.array(page, other)).alias("item"))
        files = each.select("archive", F.col("item.name").alias("entry"), F.encode("item.text", "UTF-8").alias("content"), (~F.col("archive").isin("b1.hbk", "b3.hbk")).alias("ended"))
        ar.pack(files, path, before=bytes(16)).count()

    path = kept(spark, "books", [f"{sf_dir}/part.parquet"], build)
    pages = hb.read_pages(spark, path)
    return pages.select(F.element_at(F.split("path", "/"), -1).alias("book"), "entry", tx.page_title(F.col("html")).alias("title"))


@query("SELECT 'R' || r_regionkey AS name, r_name AS synonym, 'c' || r_regionkey AS comment FROM region")
def role_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import objects as ob

    r = table(spark, sf_dir, "region")
    key = F.col("r_regionkey").cast("string")
    xml = F.concat(F.lit("<MetaDataObject><Role><Properties><Name>R"), key, F.lit("</Name><Synonym><item><content>"), "r_name", F.lit("</content></item></Synonym><Comment>c"), key, F.lit("</Comment></Properties></Role></MetaDataObject>"))
    rows = r.select(F.lit("Role").alias("type"), F.concat(F.lit("R"), key).alias("name"), F.concat(F.lit("Roles/R"), key, F.lit(".xml")).alias("path"), xml.alias("xml"), F.lit(True).alias("well_formed"))
    return ob.roles(rows).select("name", "synonym", "comment")


@query(f"WITH {_M} SELECT 'objects' AS index, 4 * (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'modules', count(DISTINCT n) FROM m UNION ALL SELECT 'chunks', count(*) FROM m WHERE k % 3 <> 0")
def dump_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register the dump, build its indexes, and say how many rows some have."""
    root, source = new_path(spark, "registry"), dump(spark, sf_dir)
    entry = spark.range(1).select(F.lit("ut").alias("name"), F.lit("1").alias("version"), F.lit(source).alias("path"), F.current_timestamp().alias("added_at"), F.lit(None).cast("timestamp").alias("indexed_at"))
    so.register(spark, f"{root}/registry", entry)
    built = indexing.build_registered(spark, f"{root}/registry", f"{root}/indexes", "ut")["1"]
    return spark.createDataFrame([(n, built[n]) for n in ("objects", "modules", "chunks")], "index string, rows long")


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name, [n_regionkey, n_nationkey] AS ids FROM nation")
def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as JSON and read back."""
    path = new_path(spark, "json")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"), F.array("n_regionkey", "n_nationkey").alias("ids"))
    so.save_json(rows, path)
    return so.load_json(spark, path, "key int, name string, ids array<int>")


@query(f"WITH {_RULES_SQL.format(q='an')}, h AS (SELECT id, type, score FROM s WHERE score > 0 ORDER BY score DESC, place, id LIMIT 20) SELECT id, type, score, title, 'Catalog' AS applicable FROM h JOIN s USING (id, type, score)")
def hit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules behind the hits of a search."""
    rules = _rules(spark, sf_dir)
    found = lo.hit_rules(lo.search_kb(rules, "an", 20), rules)
    return found.select("id", "type", "score", "title", F.array_join("applicable_to", ",").alias("applicable"))


@query("""
SELECT s_suppkey, s_suppkey % 3 <> 0 AS branch, s_suppkey % 4 <> 0 AS repository, s_suppkey % 5 <> 0 AS inside, s_suppkey % 2 = 0 AS plan, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey % 10 END AS artifact,
  'pg://u:***@h/' || s_suppkey AS dsn, (s_suppkey % 10)::INT AS files, (s_suppkey % 100)::INT AS insertions, 0 AS deletions, '[' || s_nationkey || '.5,-1.0]' AS vector FROM supplier
""")
def reference_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of branches, repositories, paths, plans and artifacts, connection strings, diff summaries and vectors as texts."""
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    odd = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    stat = re.diff_stat(text(" ", k % 10, " files changed, ", k % 100, " insertions(+)"))
    vector = re.vector_literal(re.vector_parse(text(" [", F.col("s_nationkey"), ".5 , -1]")))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", re.branch_valid(odd(3, text("a..", k), text("fix/", k))).alias("branch"), re.repository_valid(odd(4, text("o w/", k), text("o/", k))).alias("repository"),
        re.inside_root(odd(5, text("a/../../", k), text("a/", k, "..x"))).alias("inside"), re.plan_id_valid(F.when(k % 2 == 0, text("plan-", k)).otherwise(text("plan ", k))).alias("plan"),
        re.artifact_ref(text("p#", k, "#", k % 10))["number"].alias("artifact"), re.mask_dsn(text("pg://u:secret@h/", k)).alias("dsn"), stat["files"].alias("files"), stat["insertions"].alias("insertions"), stat["deletions"].alias("deletions"), vector.alias("vector"),
    )


@query("SELECT 'Catalog' AS parent_type, 'C' || n_nationkey AS parent_name, 'Main' AS name, n_name AS title FROM nation WHERE n_nationkey = 3")
def form_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form of an object by its name, out of the forms of all nations' catalogs, read from files."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")

    def build(path: str) -> None:
        own = n.select(F.concat(F.lit("Catalogs/C"), key, F.lit("/Forms/Main.xml")).alias("entry"), F.lit("<MetaDataObject><Form><Properties><Name>Main</Name></Properties></Form></MetaDataObject>").alias("x"))
        ext = n.select(F.concat(F.lit("Catalogs/C"), key, F.lit("/Forms/Main/Ext/Form.xml")), F.concat(F.lit("<Form><v8:Title><v8:item><v8:content>"), "n_name", F.lit("</v8:content></v8:item></v8:Title></Form>")))
        ar.unpack(own.union(ext).select("entry", F.encode("x", "UTF-8").alias("content"), F.lit(None).cast("string").alias("problem")), path).count()

    from ..sources import objects as ob

    path = kept(spark, "forms", [f"{sf_dir}/nation.parquet"], build)
    return lo.form_by_name(ob.forms(ob.read_forms(spark, path)), "Catalog.C3", "Main").select("parent_type", "parent_name", "name", "title")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey + 1000000000, -1.0, 'N' FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT o_orderkey, -1.0, 'N' FROM orders WHERE o_orderkey % 97 = 0 AND o_orderpriority = '5-LOW'
""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders are deleted, then rows come in that change one column of those that are there and are whole otherwise."""
    path = new_path(spark, "orders")
    orders = table(spark, sf_dir, "orders")
    ve.replace_table(orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), path, ["o_orderkey"])
    ve.delete_rows(spark, path, F.col("o_orderpriority") == "5-LOW")
    some = orders.where("o_orderkey % 97 = 0")
    new = some.select(F.explode(F.array("o_orderkey", F.col("o_orderkey") + 1_000_000_000)).alias("o_orderkey"), F.lit(-1.0).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"), F.lit("").alias("o_orderpriority"))
    ve.upsert_table(new, path, columns=["o_totalprice"])
    return ve.read_table(spark, path).drop("o_orderpriority")


@query("""
SELECT n_name AS name, n_regionkey::VARCHAR AS version, n_nationkey % 2 = 1 AS indexed FROM nation WHERE n_nationkey <> 4
""")
def registry_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation is registered, one twice; every other one is marked as indexed, and one taken out."""
    path = new_path(spark, "registry")
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("version"), F.lit("a").alias("path"), F.current_timestamp().alias("added_at"), F.lit(None).cast("timestamp").alias("indexed_at"))
    so.register(spark, path, rows)
    so.register(spark, path, rows.limit(1), replace=True)
    odd = so.read_registry(spark, path).join(n.where("n_nationkey % 2 = 1").select(F.col("n_name").alias("name")), "name", "left_semi")
    ve.upsert_table(odd.withColumn("indexed_at", F.current_timestamp()), path, columns=["indexed_at"])
    gone = n.where("n_nationkey = 4").select("n_name", F.col("n_regionkey").cast("string").alias("v")).first()
    so.unregister(spark, path, gone["n_name"], gone["v"])
    return so.read_registry(spark, path).select("name", "version", F.col("indexed_at").isNotNull().alias("indexed"))
