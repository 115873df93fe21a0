"""Thin queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .bpe import round_trip
from .codes import ENTRIES, PARTS, ROUNDS, SCALE, compress_vectors
from .html_extract import extract_text
from .media import media_digests
from .mixing import mix_sources
from .neardup import near_duplicates
from .pii import find_personal_data
from .quality import judge_quality
from .sharding import shard_documents
from .substring import LEAST_WORDS, LONG, remove_repeated_passages
from .url_filter import default_rules, judge_urls
from .warc import archive_round_trip
from .whitening import whitened_components

SPACE, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), default_rules(spark))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds one after another; products of these integers are exact as doubles."""
    sql = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM k, range(0, {parts}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),"""
    near = "SELECT vec_id, p, first(label) AS label, first(x) AS x, min(struct_pack(d := list_inner_product(c, c) - 2 * list_inner_product(x, c), e := e)) AS m FROM x JOIN b{i} USING (p) GROUP BY vec_id, p"
    for i in range(rounds):
        sql += f"""
a{i} AS MATERIALIZED ({near.format(i=i)}),
s{i} AS (SELECT p, m.e AS e, unnest(x) AS v, unnest(range(0, len(x))) AS j FROM a{i}),
g{i} AS (SELECT p, e, list(c ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(v) / count(*)) AS c FROM s{i} GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(g{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN g{i} USING (p, e)),"""
    return sql + f"""
z AS ({near.format(i=rounds)}),
r AS (SELECT vec_id, first(label) AS label, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, sum(m.d + list_inner_product(x, x))::BIGINT AS error FROM z GROUP BY 1),
h AS (SELECT lower(sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e))) AS said FROM b{rounds})
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, said AS codebooks_sha256 FROM r, h"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_media": op4_media,
    "op5_html": op5_html,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_url_filters": op10_url_filters,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, unhex(sha1(h)) AS raw, range(0, 32) AS idx FROM p),
bits AS (SELECT page_id, h, first, array_to_string(list_transform(range(0, 20), lambda i: lpad(bin(('0x' || substr(sha1(h), 2 * i::INT + 1, 2))::INT), 8, '0')), '') AS b FROM d)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(b, (5 * i + j + 1)::INT, 1) = '1' THEN (16 >> j::INT) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM bits
""",
    "op10_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(rule, action, h, q) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM p JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""",
    "op11_vector_codes": _codes_sql(),
    "op8_substring_dedup": rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}*{SOLID}+{SPACE}*') AS parts FROM documents),
one AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS k FROM cut),
marked AS (SELECT *, regexp_extract(part, '{SOLID}+') AS word, regexp_matches(part, '[.!?,;:]{SPACE}*$|\n{SPACE}*$|{SOLID}{{{LONG},}}') AS ends FROM one),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM marked),
units AS (SELECT doc_id, unit, min(k) AS a, max(k) + 1 AS e, string_agg(part, '' ORDER BY k) AS piece FROM numbered GROUP BY ALL),
words AS (SELECT doc_id, list(word ORDER BY k) AS ws FROM marked GROUP BY ALL),
reach AS (SELECT u.doc_id, u.unit, u.a, v.unit AS last, v.e FROM units u ASOF JOIN units v ON u.doc_id = v.doc_id AND u.a + {LEAST_WORDS} <= v.e),
spans AS (SELECT reach.doc_id, unit, last, array_to_string(list_slice(ws, a + 1, e), ' ') AS said FROM reach JOIN words USING (doc_id)),
later AS (SELECT doc_id, unit, last FROM spans QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, unit) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(unit::BIGINT, last::BIGINT + 1)) AS unit FROM later),
kept AS (SELECT units.*, gone.unit IS NOT NULL AS removed FROM units LEFT JOIN gone ON gone.doc_id = units.doc_id AND gone.unit = units.unit)
SELECT d.doc_id, count(k.doc_id)::BIGINT AS n_sentences, coalesce(sum(k.removed::INT), 0)::BIGINT AS n_removed,
  CASE WHEN count(k.doc_id) = 0 THEN coalesce(any_value(d.text), '') ELSE coalesce(string_agg(k.piece, '' ORDER BY k.unit) FILTER (WHERE NOT k.removed), '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
""",
}
