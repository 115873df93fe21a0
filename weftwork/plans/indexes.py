"""Queries of the parsers, index builders, lookups and compositions, over sources that are composed from the driver tables.

The driver has no modules or metadata files, so each query first makes their texts from rows (`supplier` as methods of a
module for each nation, `nation` as XML objects, `part`, `supplier` and `customer` as rules); the SQL has the expected rows
straight from the tables.
"""

from __future__ import annotations

import io
import sqlite3
import zipfile

import pyarrow as pw
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import generated_path
from ..operators import boundaries as bo
from ..operators import builders as bu
from ..operators import findings as fd
from ..operators import graph as gr
from ..operators import lookups as lo
from ..operators import rules as ru
from ..operators import search as se
from ..operators import text as tx
from ..session import table
from ..sources import archives as ar
from ..sources import helpbook as hb
from ..sources import lint as li
from ..sources import metadata as md
from ..sources import modules as mo
from ..sources import objects as ob
from ..sources import paths as pa
from ..sources import sqlite as sq
from .registry import _COS, _EDGES, _OVERLAP, TERMS, _vector, dependency_edges, query


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, module, ref, kind): a module for each nation with suppliers, whose methods are the suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))

    def block(key, i):
        before = F.coalesce(F.get("keys", i - 1), F.lit(0))
        head = F.concat(F.lit("Процедура М"), key.cast("string"), F.lit("(А, Б = 1)"), F.when(key % 3 != 0, " Экспорт").otherwise(""))
        far = F.concat(F.lit("  Н"), (key * 7 % 30).cast("string"), F.lit(".М"), (key % 11).cast("string"), F.lit("(1); Запрос.М1(\"//\"); // Н1.М1()"))
        near = F.concat(F.lit("  М"), before.cast("string"), F.lit("(2); Если (А) Тогда М"), key.cast("string"), F.lit("();"))
        return F.concat_ws("\n", head, far, near, F.lit("КонецПроцедуры"))

    text = F.array_join(F.transform("keys", block), "\n")
    path = F.concat(F.lit("CommonModules/Н"), F.col("s_nationkey").cast("string"), F.lit("/Ext/Module.bsl"))
    out = rows.select(path.alias("path"), text.alias("text"))
    info = pa.module_info(F.col("path"))
    return out.select("path", "text", pa.module_name(F.col("path")).alias("module"), info["ref"].alias("ref"), info["kind"].alias("kind"))


_M = """m AS (SELECT s_suppkey AS k, s_nationkey AS n, 'CommonModule.Н' || s_nationkey AS ref, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i,
  coalesce(lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 0) AS b FROM supplier)"""


@query(f"WITH {_M} SELECT 'CommonModules/Н' || n || '/Ext/Module.bsl' AS path, 'М' || k AS name, false AS is_function, k % 3 <> 0 AS is_export, false AS is_async, (4 * i + 1)::INT AS start_line, (4 * i + 4)::INT AS end_line, 2 AS n_parameters FROM m")
def module_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.methods(_modules(spark, sf_dir)).withColumn("n_parameters", F.size("parameters")).drop("parameters")


_CALLS = f"""WITH {_M}, own AS (SELECT DISTINCT n FROM m), ex AS (SELECT n, k FROM m WHERE k % 3 <> 0),
far AS (SELECT ref AS src, 'М' || k AS src_method, 'CommonModule.Н' || k * 7 % 30 AS dst, 'М' || k % 11 AS dst_method, (4 * i + 2)::INT AS line_no FROM m WHERE k * 7 % 30 IN (SELECT n FROM own)),
said AS (SELECT n, ref, k, k % 11 AS c, (4 * i + 2)::INT AS line_no FROM m UNION ALL SELECT n, ref, k, 1, (4 * i + 2)::INT FROM m UNION ALL SELECT n, ref, k, b, (4 * i + 3)::INT FROM m),
near AS (SELECT ref, 'М' || said.k, NULL, 'М' || c, line_no FROM said JOIN ex ON ex.n = said.n AND ex.k = c WHERE c <> said.k),
calls AS (SELECT * FROM far UNION ALL SELECT * FROM near)"""


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    modules = _modules(spark, sf_dir)
    exports = mo.methods(modules).where("is_export").join(modules.select("path", "module"), "path").select("module", F.col("name").alias("method"))
    return bu.call_graph(modules, exports, bu.call_sites(modules)), modules, exports


@query(_CALLS + " SELECT * FROM calls")
def call_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)[0]


@query(_CALLS + " SELECT count(*) AS calls, count(dst) AS cross_module, (SELECT count(*) FROM own) AS modules, (SELECT count(*) FROM ex) AS exports FROM calls")
def call_graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bu.call_totals(*_calls(spark, sf_dir))


_BODY = "'Процедура М' || k || '(А, Б = 1)' || CASE WHEN k % 3 <> 0 THEN ' Экспорт' ELSE '' END || chr(10) || '  Н' || k * 7 % 30 || '.М' || k % 11 || '(1); Запрос.М1(\"//\"); // Н1.М1()' || chr(10) || '  М' || b || '(2); Если (А) Тогда М' || k || '();' || chr(10) || 'КонецПроцедуры'"


@query(f"WITH {_M} SELECT 'ut_1_' || ref || '_М' || k AS chunk_id, ref, 'М' || k AS method_name, 'Процедура М' || k || '(А, Б)' || chr(10) || {_BODY} AS code_text FROM m WHERE k % 3 <> 0")
def method_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    return bu.method_chunks(modules, mo.methods(modules), "ut_1")


@query(f"WITH {_M} SELECT ref, 'М' || k AS name, (4 * i + 1)::INT AS start_line FROM m WHERE k % 3 <> 0 AND n = (SELECT min(n) FROM m WHERE n % 10 = 3 AND k % 3 <> 0)")
def api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the name's end, as no module has the name itself."""
    modules = _modules(spark, sf_dir)
    reference = bu.api_reference(mo.methods(modules), modules)
    least = table(spark, sf_dir, "supplier").where("s_nationkey % 10 = 3 and s_suppkey % 3 <> 0").agg(F.min("s_nationkey")).first()[0]
    return lo.api_of(reference, f"Н{least}").select("ref", "name", "start_line")


@query(f"WITH {_M} SELECT ref, 'М' || k AS name FROM m WHERE k % 3 <> 0 AND starts_with(ref, 'CommonModule.Н1')")
def api_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    return lo.api_by_prefix(bu.api_reference(mo.methods(modules), modules), "CommonModule.Н1").select("ref", "name")


@query(f"WITH {_M} SELECT 'CommonModules/Н' || n || '/Ext/Module.bsl' AS path, string_agg({_BODY}, chr(10) ORDER BY k) AS text FROM m WHERE n = 3 GROUP BY n")
def module_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.module_of(_modules(spark, sf_dir), "CommonModule.Н3", "CommonModule").select("path", "text")


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of documents, which are orders: the customer, and in a tabular section the parts."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = o.select(F.lit("Document").alias("type"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("tabular_section"), F.lit("Клиент").alias("attr_name"), F.concat(F.lit("СправочникСсылка.c"), F.col("o_custkey").cast("string"), F.lit(", cfg:DocumentRef.o"), (F.col("o_orderkey") % 9).cast("string")).alias("attr_type"))
    rows = l.select(F.lit("Document"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.lit("Товары"), F.lit("Товар"), F.concat(F.lit("CatalogRef.p"), F.col("l_partkey").cast("string")))
    return head.union(rows)


_DEPS = """WITH e AS (
  SELECT 'Document.o' || o_orderkey AS src, 'Catalog.c' || o_custkey AS dst, 'uses_attribute' AS edge_type, 'реквизит Клиент' AS detail FROM orders
  UNION ALL SELECT 'Document.o' || o_orderkey, 'Document.o' || o_orderkey % 9, 'uses_attribute', 'реквизит Клиент' FROM orders WHERE o_orderkey <> o_orderkey % 9
  UNION ALL SELECT 'Document.o' || l_orderkey, 'Catalog.p' || l_partkey, 'uses_attribute', 'ТЧ Товары.Товар' FROM lineitem
  UNION ALL SELECT 'AccumulationRegister.n' || n_nationkey, 'Document.o' || n_regionkey, 'registered_by', 'регистратор' FROM nation)"""


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    recorders = n.select(F.when(F.col("n_nationkey") >= 0, "AccumulationRegister").alias("type"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("Document.o"), F.col("n_regionkey").cast("string")).alias("recorder"))
    return bu.dependency_graph(_attributes(spark, sf_dir), recorders)


@query(_DEPS + " SELECT * FROM e")
def dependency_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dependencies(spark, sf_dir)


@query(_DEPS + ", n AS (SELECT unnest([src, dst]) AS node FROM e UNION ALL SELECT 'Catalog.p' || p_partkey FROM part) SELECT (SELECT count(*) FROM e) AS edges, count(DISTINCT node) AS nodes FROM n")
def dependency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.lit("Catalog").alias("type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return bu.dependency_totals(_dependencies(spark, sf_dir), parts)


@query(f"""WITH {_EDGES}, a AS (SELECT src FROM edges WHERE dst = 'region.1'), b AS (SELECT src FROM edges WHERE dst IN (FROM a)),
f AS (SELECT * FROM edges WHERE dst = 'region.1' OR dst IN (FROM a) OR dst IN (FROM b))
SELECT src, dst, (SELECT count(*) FROM f) AS total, (SELECT count(*) > 20 FROM f) AS truncated FROM f ORDER BY src, dst LIMIT 20
""")
def dependency_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total, cut = gr.dependency_view(dependency_edges(spark, sf_dir), "region.1", "in", 3, 20)
    return rows.withColumn("total", F.lit(total)).withColumn("truncated", F.lit(cut))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML of a catalog, a document, a common module and a subsystem for each nation."""
    n = table(spark, sf_dir, "nation")
    key, region, name = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.col("n_name")

    def xml(kind: str, inner, children):
        synonym = F.concat(F.lit("<Synonym><item><lang>ru</lang><content>"), name, F.lit("</content></item></Synonym>"))
        body = F.concat(F.lit(f"<MetaDataObject><{kind} uuid='u-"), key, F.lit(f"'><Properties><Name>{kind[0]}"), key, F.lit("</Name>"), synonym, inner, F.lit("</Properties><ChildObjects>"), children, F.lit(f"</ChildObjects></{kind}></MetaDataObject>"))
        return F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"{kind[0]}"), key).alias("name"), F.concat(F.lit(f"{kind}s/{kind[0]}"), key, F.lit(".xml")).alias("path"), body.alias("xml"), F.lit(True).alias("well_formed"))

    even = F.col("n_nationkey") % 2 == 0
    forms = F.concat(F.lit("<Form> F"), region, F.lit(" </Form><Form/><Command>C"), key, F.lit("</Command>"))
    catalog = xml("Catalog", F.concat(F.when(even, F.concat(F.lit("<CodeLength>"), region, F.lit("1</CodeLength>"))).otherwise("<CodeLength>x</CodeLength>"), F.lit("<Owners><Item> cfg:Catalog.O"), region, F.lit("</Item><Item>none</Item></Owners>")), forms)
    document = xml("Document", F.concat(F.when(even, "<Posting>Deny</Posting>").otherwise(""), F.lit("<RegisterRecords><Item>AccumulationRegister.R"), region, F.lit("</Item><Item> </Item></RegisterRecords>")), forms)
    module = xml("CommonModule", F.concat(F.when(even, "<Server>false</Server>").otherwise(""), F.lit("<Global>TRUE</Global>")), F.lit(""))
    subsystem = xml("Subsystem", F.concat(F.lit("<Content><Item>Catalog.C"), key, F.lit("</Item><Item>broken</Item><Item>Role.R.S</Item></Content>")), F.lit(""))
    return n.select(F.explode(F.array(catalog, document, module, subsystem)).alias("x")).select("x.*")


@query("""
SELECT 'C' || n_nationkey AS name, 'u-' || n_nationkey AS uuid, n_name AS synonym, 'HierarchyItems' AS hierarchy_type, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 10 + 1 ELSE 9 END AS code_length,
  50 AS description_length, 'cfg:Catalog.O' || n_regionkey AS owners, 'F' || n_regionkey AS forms, 'C' || n_nationkey AS commands FROM nation
""")
def catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ob.catalogs(_objects(spark, sf_dir))
    return got.select("name", "uuid", "synonym", "hierarchy_type", "code_length", "description_length", *[F.array_join(c, ",").alias(c) for c in ("owners", "forms", "commands")])


@query("SELECT 'D' || n_nationkey AS name, 9 AS number_length, 'String' AS number_type, CASE WHEN n_nationkey % 2 = 0 THEN 'Deny' ELSE 'Allow' END AS posting, 'AccumulationRegister.R' || n_regionkey AS register_records FROM nation")
def document_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.documents(_objects(spark, sf_dir)).select("name", "number_length", "number_type", "posting", F.array_join("register_records", ",").alias("register_records"))


@query("SELECT 'C' || n_nationkey AS name, n_nationkey % 2 <> 0 AS server, true AS \"global\", false AS client, false AS privileged FROM nation")
def common_module_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.common_modules(_objects(spark, sf_dir)).select("name", "server", "global", "client", "privileged")


@query("SELECT 'S' || n_nationkey AS name, 'Catalog.C' || n_nationkey || ',Role.R.S' AS content FROM nation")
def subsystem_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.subsystems(_objects(spark, sf_dir)).select("name", F.array_join(F.transform("content", lambda x: F.concat_ws(".", x["type"], x["name"])), ",").alias("content"))


@query("SELECT 'Catalog' AS type, 'C' || n_nationkey AS name, t AS child_type, CASE t WHEN 'Form' THEN 'F' || n_regionkey ELSE 'C' || n_nationkey END AS children FROM nation, (VALUES ('Form'), ('Command')) v(t)")
def child_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.child_objects(_objects(spark, sf_dir).where("type = 'Catalog'")).withColumn("children", F.array_join("children", ","))


@query("SELECT 'Root' AS name, '1.2' AS version, '8.3.' || (SELECT max(n_nationkey) FROM nation) AS platform_version, 'Managed' AS data_lock_control_mode, 'X' AS default_language, (SELECT count(*) FROM nation) AS catalogs, (SELECT count(*) FROM region) AS roles")
def configuration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t, k, tag: table(spark, sf_dir, t).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(f"<{tag}>x"), F.col(k).cast("string"), F.lit(f"</{tag}>")))), "").alias(tag), F.max(k).alias(f"most_{tag}"))
    both = names("nation", "n_nationkey", "Catalog").crossJoin(names("region", "r_regionkey", "Role"))  # one row each
    xml = F.concat(F.lit("<MetaDataObject><Configuration><Properties><Name>Root</Name><Version>1.2</Version><CompatibilityMode>Version8_3_"), F.col("most_Catalog").cast("string"), F.lit("_1</CompatibilityMode><DefaultLanguage>Language.X</DefaultLanguage></Properties><ChildObjects>"), "Catalog", "Role", F.lit("</ChildObjects></Configuration></MetaDataObject>"))
    counts = F.col("object_counts")
    return ob.configuration_of(both.select(xml.alias("xml"))).select("name", "version", "platform_version", "data_lock_control_mode", "default_language", counts["Catalog"].cast("long").alias("catalogs"), counts["Role"].cast("long").alias("roles"))


@query("SELECT 'Document' AS parent_type, 'D' || n_nationkey AS parent_name, 'M' || n_regionkey AS name, n_name AS title, 'OnOpen=Open' || n_nationkey AS events, 'A,B' AS attributes, '0:G,1:F' || n_nationkey AS elements FROM nation")
def form_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    ext = F.concat(F.lit("<Form><Title><item><content>"), F.col("n_name"), F.lit("</content></item></Title><Events><Event name='OnOpen'> Open"), key, F.lit(" </Event></Events><Attributes><Attribute name='A' id='1'/><Attribute name='B'/></Attributes><ChildItems><Group name='G'><ChildItems><Field name='F"), key, F.lit("'/></ChildItems></Group></ChildItems></Form>"))
    rows = n.select(F.concat(F.lit("Documents/D"), key, F.lit("/Forms/M"), region, F.lit(".xml")).alias("path"), F.lit("<MetaDataObject><Form uuid='f'><Properties/></Form></MetaDataObject>").alias("xml"), ext.alias("ext"))
    parts = ob.form_elements(rows).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("depth").cast("string"), "element"))), ",").alias("elements"))
    events = F.array_join(F.transform(F.map_entries("events"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("events")
    return ob.forms(rows).join(parts, "path").select("parent_type", "parent_name", "name", "title", events, F.array_join("attributes", ",").alias("attributes"), "elements")


@query("SELECT 'Document' AS type, 'D3' AS name, 'Documents/D3.xml' AS path FROM nation WHERE n_nationkey = 3")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.object_by_ref(_objects(spark, sf_dir), "Document.D3").select("type", "name", "path")


@query("""
SELECT s_suppkey, 'Rows' AS tabular_section, 'A' || s_nationkey AS attr_name, 'СправочникСсылка.N' || s_nationkey AS attr_type, s_suppkey % 2 = 0 AS required FROM supplier
""")
def attribute_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey").cast("string")
    attr = F.concat(F.lit("<Attribute><Properties><Name>A"), n, F.lit("</Name><Type><Type>cfg:CatalogRef.N"), n, F.lit("</Type></Type>"), F.when(F.col("s_suppkey") % 2 == 0, "<FillChecking>Show</FillChecking>").otherwise(""), F.lit("</Properties></Attribute>"))
    xml = F.concat(F.lit("<MetaDataObject><Document><ChildObjects><TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>"), attr, F.lit("</ChildObjects></TabularSection></ChildObjects></Document></MetaDataObject>"))
    rows = s.select(F.lit("Document").alias("type"), F.col("s_suppkey").cast("string").alias("name"), xml.alias("xml"), F.lit(True).alias("well_formed"))
    return md.attributes(rows).select(F.col("name").cast("long").alias("s_suppkey"), "tabular_section", "attr_name", "attr_type", "required")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of parts, suppliers and customers, with texts in all fields that a search scores."""
    none = F.lit(None).cast("string")
    kinds = (("part", "pattern", "p_partkey", "p_name", "p_type"), ("supplier", "antipattern", "s_suppkey", "s_name", "s_name"), ("customer", "standard", "c_custkey", "c_name", "c_mktsegment"))
    out = None
    for t, kind, key, title, tags in kinds:
        by = lambda n, text, of=key: F.when(F.col(of) % n == 0, text)
        rows = table(spark, sf_dir, t).select(
            F.concat(F.lit(f"{kind}-"), F.lpad(F.col(key).cast("string"), 9, "0")).alias("id"), F.lit(kind).alias("type"), F.col(title).alias("title"), F.split(tags, " ").alias("tags"),
            by(2, F.concat(F.lit("Say "), title)).alias("description"), by(3, F.lit("When it can be done")).alias("when_to_use"), by(4, F.lit("Use the plain form")).alias("recommendation_for_llm"), by(5, F.lit("transactions")).alias("category"),
            by(6, F.lit("an-1")).alias("source_code"), by(7, F.lit("standard")).alias("source_type"), by(7, F.lit("http://x")).alias("source_url"),
            F.when(F.col(key) % 2 == 0, "critical").otherwise("info").alias("severity"), F.when(F.col(key) % 3 == 0, "x+").alias("regex_pattern"), none.alias("flags"), F.lit("a()").alias("ast_pattern"), none.alias("linter_rule"), F.array(F.lit("Catalog")).alias("applicable_to"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_RULES_SQL = """r AS (
  SELECT 'pattern-' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_partkey AS k, 'pattern' AS type, p_name AS title, string_split(p_type, ' ') AS tags, 1 AS place FROM part
  UNION ALL SELECT 'antipattern-' || lpad(s_suppkey::VARCHAR, 9, '0'), s_suppkey, 'antipattern', s_name, string_split(s_name, ' '), 2 FROM supplier
  UNION ALL SELECT 'standard-' || lpad(c_custkey::VARCHAR, 9, '0'), c_custkey, 'standard', c_name, string_split(c_mktsegment, ' '), 3 FROM customer),
s AS (SELECT id, type, title, place, round(contains(lower(title), '{q}')::INT * 1.0 + contains(id, '{q}')::INT * 0.8 + 0.5 * len(list_filter(tags, lambda t: contains(lower(t), '{q}')))
  + 0.3 * ((k % 2 = 0 AND contains('say ' || lower(title), '{q}'))::INT + (k % 3 = 0 AND contains('when it can be done', '{q}'))::INT + (k % 4 = 0 AND contains('use the plain form', '{q}'))::INT + (k % 5 = 0 AND contains('transactions', '{q}'))::INT)
  + 0.7 * (k % 6 = 0 AND contains('an-1', '{q}'))::INT + 0.4 * (k % 7 = 0 AND contains('standard', '{q}'))::INT, 6)::DOUBLE AS score FROM r)"""


@query(f"WITH {_RULES_SQL.format(q='an')} SELECT id, type, title, score FROM s WHERE score > 0 ORDER BY score DESC, place, id LIMIT 20")
def search_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three collections at once."""
    return lo.search_kb(_rules(spark, sf_dir), "an", 20)


@query("SELECT 'pattern-000000007' AS id, 'ast' AS detect_method, false AS applicable FROM part WHERE p_partkey = 7")
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.rule_by_id(_rules(spark, sf_dir), "pattern-000000007", "Document").select("id", "detect_method", "applicable")


_HYBRID = f"""t AS (SELECT doc_id, {_OVERLAP} AS s FROM d), tt AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM t WHERE s > 0 QUALIFY r <= 10),
v AS (SELECT doc_id, {_COS} AS s FROM d), vv AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM v QUALIFY r <= 10),
u AS (SELECT doc_id, r, 0 AS src FROM tt UNION ALL SELECT doc_id, r, 1 FROM vv),
f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(src * 1000 + r) AS first FROM u GROUP BY 1 ORDER BY score DESC, first LIMIT 5)"""


@query(f"""
WITH d AS (SELECT doc_id, text, embedding, lang, source FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'de' AND source = 'src3'), {_HYBRID}
SELECT f.doc_id, row_number() OVER (ORDER BY score DESC, f.doc_id)::INT AS rank, score, substr(text, 1, 200) AS snippet, lang, source FROM f JOIN d USING (doc_id)
""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language as the configuration and a source as its version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return se.semantic_search(chunks, TERMS, _vector(spark, sf_dir, 0), {"lang": "de", "source": "src3", "n_chars": None}, 5, "doc_id", "text", "embedding")


_FIRST_CODE = f"""c AS (SELECT doc_id, {_OVERLAP} AS score FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 3)"""


@query(f"WITH {_RULES_SQL.format(q='an')}, k AS (SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, place, id LIMIT 3), {_FIRST_CODE} SELECT 'rule' AS part, id, score FROM k UNION ALL SELECT 'code', doc_id::VARCHAR, score FROM c")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = se.scored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TERMS)
    return lo.explain(_rules(spark, sf_dir), code, "an", "doc_id")


@query(f"""
WITH {_RULES_SQL.format(q='an')}, {_M}, {_FIRST_CODE},
p AS (SELECT 'pattern' AS part, score AS s, id || ': ' || title AS line FROM s WHERE score > 0 AND type = 'pattern' ORDER BY score DESC, id LIMIT 3),
a AS (SELECT 'antipattern' AS part, 0.0::DOUBLE AS s, id || ': ' || title AS line FROM s WHERE type = 'antipattern' AND id[-9:]::INT % 2 = 0 ORDER BY id LIMIT 5),
x AS (SELECT 'method' AS part, 0.0::DOUBLE AS s, ref || '.М' || k AS line FROM m WHERE k % 3 <> 0 ORDER BY ref, 'М' || k LIMIT 10),
y AS (SELECT * FROM p UNION ALL SELECT * FROM a UNION ALL SELECT * FROM x UNION ALL SELECT 'code', score, doc_id::VARCHAR FROM c)
SELECT part, row_number() OVER (PARTITION BY part ORDER BY s DESC, line)::INT AS ord, line FROM y
""")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    api = lo.api_by_prefix(bu.api_reference(mo.methods(modules), modules), "")
    code = se.scored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TERMS)
    return lo.gather(_rules(spark, sf_dir), api, code, "an", "doc_id")


@query("""
WITH w AS (SELECT r_name AS name, r_regionkey::VARCHAR AS version, unnest(['error', 'nothing']) AS index FROM region),
i AS (SELECT (user_id % 3)::VARCHAR AS version, event_type AS index, max(ts) AS t, min(ts) AS u FROM events GROUP BY 1, 2)
SELECT name, w.version, w.index, t IS NOT NULL AS present, t IS NOT NULL AND t >= u AS fresh FROM w LEFT JOIN i ON i.version = w.version AND i.index = w.index
""")
def data_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("version"))
    found = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).cast("string").alias("version"), F.col("event_type").alias("index")).agg(F.max("ts").alias("index_time"), F.min("ts").alias("source_time"))
    return lo.data_status(names, found.join(names, "version"), ["error", "nothing"])


@query(f"""
WITH {_M}, t AS (SELECT n, unnest([{{'c': k, 'l': 4 * i + 1}}, {{'c': k % 11, 'l': 4 * i + 2}}, {{'c': 1, 'l': 4 * i + 2}}, {{'c': b, 'l': 4 * i + 3}}, {{'c': k, 'l': 4 * i + 3}}, {{'c': 1, 'l': 4 * i + 2}}]) AS x FROM m)
SELECT 'CommonModules/Н' || n || '/Ext/Module.bsl' AS path, 'METHOD-CONTEXT-М' || x.c AS code, min(x.l)::INT AS line FROM t WHERE x.c IN (1, 2, 3) GROUP BY 1, 2
""")
def availability_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three methods that the server lacks; others are unknown and so available."""
    methods = spark.createDataFrame([("М1", 0), ("М2", 0), ("М3", 0), ("М4", 1)], "name string, server int")
    return ru.unavailable_calls(_modules(spark, sf_dir), "path", "text", methods, "server", bu.KEYWORDS).select("path", "code", "line")


@query("""
WITH g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c, event_id FROM events)
SELECT user_id, 'R' || event_id AS name, (2 * r - 1)::INT AS start_line, (2 * c + 2 - (2 * r - 1) - 1)::INT AS depth_end FROM g WHERE r = 1
""")
def region_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each event of a user, each inside the one before; the outermost ends last."""
    ids = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    opens = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("#Область R"), x.cast("string"), F.lit("\n  x = 1;"))), "\n")
    text = F.concat(opens, F.lit("\n"), F.array_join(F.transform("ids", lambda x: F.lit("#КонецОбласти")), "\n"))
    found = bu.regions(tx.lines(ids.select("user_id", text.alias("text")), "user_id", "text"), "user_id").where("parent is null")
    # The last line is the outermost region's end: 3 lines an event in all.
    sizes = ids.select("user_id", F.size("ids").alias("c"))
    return found.join(sizes, "user_id").where(F.col("end_line") == 3 * F.col("c")).select("user_id", "name", F.col("start_line").cast("int").alias("start_line"), (2 * F.col("c")).alias("depth_end"))


@query("""
SELECT p_name || ' ' || min(p_partkey) AS name, 'E' || min(p_partkey) AS name_en, 'Gl.Obj' AS category, p_name || '( x )' AS signature, min(p_partkey) % 2 = 0 AS server, min(p_partkey) % 2 <> 0 AS thin_client FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name, p_partkey
""")
def help_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, twice: the second of a name counts for nothing; two thirds are pages without markers."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    title = F.concat(F.lit("Gl.Obj."), "p_name", F.lit(" "), key, F.lit(" (Gl.Obj.E"), key, F.lit(")"))
    marked = F.concat(F.lit("<html><h1 class=\"V8SH_pagetitle\">"), title, F.lit("</h1><p class=\"V8SH_chapter\">Синтаксис:</p>"), "p_name", F.lit("(&nbsp;<i>x</i>&#32;)<p class=\"V8SH_chapter\">Доступность:</p><p>"), F.when(F.col("p_partkey") % 2 == 0, "Сервер").otherwise("Тонкий клиент"), F.lit(". Сервер, тонкий клиент.</p><hr><p>end</p></html>"))
    page = F.when(F.col("p_partkey") % 3 == 0, marked).otherwise(F.concat(F.lit("<html><h1>"), title, F.lit("</h1></html>")))
    rows = p.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"), F.col("p_partkey").cast("int").alias("pos"), key.alias("entry"), page.alias("html"))
    return hb.methods(rows).select("name", "name_en", "category", "signature", "server", "thin_client")


@query("""
WITH e AS (SELECT event_id, event_type AS code, user_id FROM events)
SELECT code, count(*) AS n, sum(user_id + 1) AS lines, count(*) FILTER (WHERE event_id % 3 = 0) AS n_critical FROM e GROUP BY 1
""")
def lint_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each event, in either form by its id."""
    issue = F.concat(F.lit("{\"code\":\""), "event_type", F.lit("\",\"severity\":\""), F.when(F.col("event_id") % 3 == 0, "Error").otherwise("Hint"), F.lit("\",\"message\":\"m\",\"range\":{\"start\":{\"line\":"), F.col("user_id").cast("string"), F.lit(",\"character\":0}}}"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{\"fileinfos\":[{\"path\":\"p\",\"diagnostics\":["), issue, F.lit("]},{\"path\":\"q\"}]}"))).otherwise(F.concat(F.lit("["), issue, F.lit("]")))
    found = li.parse_reports(table(spark, sf_dir, "events").select(text.alias("value")))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.count_if(F.col("severity") == fd.SEVERITIES[0]).alias("n_critical"))


@query("SELECT s_suppkey, 's' || s_suppkey AS path, 'a' AS package, 1 AS line_no, 'b.n' || s_nationkey || '.x' AS module, 'b.n' || s_nationkey AS forbidden FROM supplier WHERE s_nationkey < 9 UNION ALL SELECT s_suppkey, 's' || s_suppkey, 'a', 4, 'c', 'c' FROM supplier")
def import_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("from b.n"), F.col("s_nationkey").cast("string"), F.lit(".x import y\n# import c\nimport cc\n  import c\nx = 'import c'"))
    rules = table(spark, sf_dir, "nation").where("n_nationkey < 9").select(F.concat(F.lit("b.n"), F.col("n_nationkey").cast("string")).alias("prefix")).union(spark.createDataFrame([("c",)], "prefix string"))
    found = bo.forbidden_imports(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("a").alias("package"), text.alias("text")), rules.withColumn("package", F.lit("a")))
    return found.withColumn("s_suppkey", F.substring("path", 2, 99).cast("long"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CommonModules/' || source || '/Ext/Module.bsl' WHEN 1 THEN 'Catalogs/' || source || '/Ext/ObjectModule.bsl' WHEN 2 THEN 'Documents/' || source || '/Ext/ObjectModule.bsl' ELSE 'Generated/' || doc_id || '_2.bsl' END AS path FROM documents")
def generated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.lit(["CommonModule", "Catalog", "Document", "Report"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", generated_path(kind, F.col("source"), F.col("doc_id"), F.lit(2)).alias("path"))


def _files(rows: DataFrame, pack) -> DataFrame:
    """(path, content) of a file that `pack` makes of each row (path, items)."""

    def run(batches):
        for batch in batches:
            made = [pack(items.as_py()) for items in batch.column(1)]
            yield pw.RecordBatch.from_arrays([batch.column(0), pw.array(made, pw.binary())], names=["path", "content"])

    return rows.select("path", "items").mapInArrow(run, "path string, content binary")


def _zipped(items: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in items:
            z.writestr(item["name"], item["text"])
    return out.getvalue()


def _database(items: list[dict]) -> bytes:
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE TABLE platform_methods (id INTEGER PRIMARY KEY, name TEXT, signature TEXT, server INTEGER, thin_client INTEGER)")
        db.executemany("INSERT INTO platform_methods (name, signature, server, thin_client) VALUES (?, ?, ?, ?)", [(i["name"], i["text"], i["key"] % 2, None if i["key"] % 3 == 0 else 1) for i in items])
        return db.serialize()


@query("""
WITH f AS (SELECT n_regionkey AS r, CASE WHEN n_regionkey % 2 = 0 THEN '' ELSE 'Catalogs/../' END || 'n' || n_nationkey || '.xml' AS name, n_name AS text FROM nation),
roots AS (SELECT DISTINCT r, 'Configuration.xml' AS name, 'root' AS text FROM f WHERE r <> 4)
SELECT 'r' || r AS archive, CASE WHEN r = 4 THEN 'dump/' || name ELSE name END AS entry, CASE WHEN r % 2 = 1 AND text <> 'root' THEN NULL ELSE text END AS text,
  CASE WHEN r = 4 THEN 'no Configuration.xml' WHEN r % 2 = 1 AND text <> 'root' THEN 'outside of the archive' END AS problem FROM (SELECT * FROM f UNION ALL SELECT * FROM roots)
""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each region, its nations as files below one folder; some with names that lead out of it, one without
    the root file."""
    n = table(spark, sf_dir, "nation")
    own = F.concat(F.lit("dump/"), F.when(F.col("n_regionkey") % 2 == 0, "").otherwise("Catalogs/../"), F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".xml"))
    files = n.select("n_regionkey", own.alias("name"), F.col("n_name").alias("text"))
    files = files.union(n.where("n_regionkey <> 4").select("n_regionkey", F.lit("dump/Configuration.xml"), F.lit("root")).distinct())
    packed = files.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path")).agg(F.collect_list(F.struct("name", "text")).alias("items"))
    found = ar.hoisted(ar.entries(_files(packed, _zipped)))
    return found.select("archive", "entry", F.decode("content", "UTF-8").alias("text"), "problem")


@query("SELECT 'n' || s_nationkey AS path, s_name AS name, 's' || s_suppkey AS signature, s_suppkey % 2 = 1 AS server, CASE WHEN s_suppkey % 3 <> 0 THEN true END AS thin_client, NULL::BOOLEAN AS web_client FROM supplier")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database for each nation, its suppliers as methods; a column that the files lack is null."""
    s = table(spark, sf_dir, "supplier")
    packed = s.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path")).agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("text"), F.col("s_suppkey").alias("key"))).alias("items"))
    return sq.tables(_files(packed, _database), "platform_methods", "name string, signature string, server boolean, thin_client boolean, web_client boolean")


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'retry' WHEN 1 THEN 'escalate' WHEN 2 THEN 'abort' WHEN 3 THEN 'retry' WHEN 4 THEN 'escalate' END AS action,
  CASE doc_id % 6 WHEN 0 THEN 'schema_violation_loop' WHEN 1 THEN 'budget_exceeded' WHEN 3 THEN 'llm_unavailable' WHEN 4 THEN 'max_iterations_exceeded' ELSE 'tool_error' END AS reason FROM documents
""")
def error_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["SchemaViolationError", "LLMBudgetExceededError", "PersistenceError", "LLMUnavailableError", "MaxIterationsExceededError", "Other"]
    kind = F.element_at(F.lit(kinds), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", fd.error_action(kind).alias("action"), fd.error_reason(kind).alias("reason"))
