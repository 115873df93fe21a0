"""Point lookups over the indexes, and compositions of searches and lookups. Each gives few rows; an unknown key gives none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import module_path
from .search import field_score, top_k

COLLECTIONS = ("pattern", "antipattern", "standard")


def split_ref(ref: str) -> tuple[str, str]:
    """Type and name of `Type.Name`; the name may hold dots."""
    kind, dot, name = ref.partition(".")
    if not (kind and dot and name):
        raise ValueError(f"{ref!r} is no reference of the form Type.Name")
    return kind, name


def object_by_ref(objects: DataFrame, ref: str) -> DataFrame:
    """The first object (type, name, path) with a reference, by path."""
    kind, name = split_ref(ref)
    return objects.where((F.col("type") == kind) & (F.col("name") == name)).orderBy("path").limit(1)


def form_by_name(forms: DataFrame, ref: str, form: str) -> DataFrame:
    """A form of an object by its name."""
    kind, name = split_ref(ref)
    return forms.where((F.col("parent_type") == kind) & (F.col("parent_name") == name) & (F.col("name") == form)).orderBy("path").limit(1)


def api_of(reference: DataFrame, module: str, type_: str = "CommonModule") -> DataFrame:
    """The exported methods, one a row, of the first module whose ref is `CommonModule.module` or ends in `.module`; the
    exact ref comes first."""
    exact = F.col("ref") == f"{type_}.{module}"
    found = reference.where(exact | F.col("ref").endswith(f".{module}")).orderBy(exact.desc(), "ref").limit(1)
    return found.select("ref", F.explode("methods").alias("m")).select("ref", "m.*")


def api_by_prefix(reference: DataFrame, prefix: str) -> DataFrame:
    """The exported methods of all modules whose ref starts with a prefix."""
    return reference.where(F.col("ref").startswith(prefix)).select("ref", F.explode("methods").alias("m")).select("ref", "m.*")


def module_of(modules: DataFrame, ref: str, kind: str) -> DataFrame:
    """The module file (path, text) of an object by the kind of module; of several forms the first by path."""
    split_ref(ref)
    return modules.where(F.like("path", module_path(F.lit(ref), F.lit(kind)))).orderBy("path").limit(1)


def rule_by_id(rules: DataFrame, rule_id: str, applicable_to: str | None = None) -> DataFrame:
    """A rule with `detect_method`, by the first of its detectors: regex, ast, rule; and `applicable`, false where it is
    made for other objects."""
    method = F.when(F.col("regex_pattern").isNotNull(), "regex").when(F.col("ast_pattern").isNotNull(), "ast").when(F.col("linter_rule").isNotNull(), "rule")
    fits = F.lit(True) if applicable_to is None else F.coalesce((F.size("applicable_to") <= 0) | F.array_contains("applicable_to", applicable_to), F.lit(True))
    return rules.where(F.col("id") == rule_id).select("*", method.alias("detect_method"), fits.alias("applicable"))


def list_rules(rules: DataFrame, collection: str, category: str | None = None, severity: str | None = None, source_type: str | None = None, applicable_to: str | None = None) -> DataFrame:
    """The rules of a collection that pass all the filters that are given."""
    if collection not in COLLECTIONS:
        raise ValueError(f"{collection!r} is no collection")
    out = rules.where(F.col("type") == collection)
    for column, value in (("category", category), ("severity", severity), ("source_type", source_type)):
        if value:
            out = out.where(F.col(column) == value)
    return out.where(F.array_contains("applicable_to", applicable_to)) if applicable_to else out


def search_kb(rules: DataFrame, query: str, k: int = 5, collection: str = "all", most: int = 20) -> DataFrame:
    """(id, type, title, score): the rules of one collection or of all three with the highest score; ties keep the order of
    the collections, then of the ids. k is 1 to `most`."""
    if not 1 <= k <= most:
        raise ValueError(f"k has to be 1 to {most}")
    if collection not in (*COLLECTIONS, "all"):
        raise ValueError(f"{collection!r} is no collection")
    part = rules if collection == "all" else rules.where(F.col("type") == collection)
    fields: Sequence[Column] = [F.col(c) for c in ("recommendation_for_llm", "when_to_use", "category", "description")]
    score = field_score(F.col("title"), F.col("id"), F.col("tags"), fields, F.col("source_code"), F.col("source_type"), query)
    place = F.array_position(F.lit(list(COLLECTIONS)), F.col("type"))
    scored = part.select("id", "type", F.coalesce("title", F.lit("")).alias("title"), score.alias("score"), place.alias("place")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), "place", "id").limit(k).drop("place")


def hit_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules behind search hits (id, type, score) with all their fields, the best first; hits of rules that aren't there
    any more are left out. Few hits, so they are what is sent to the rules."""
    own = F.broadcast(hits.select("id", "type", "score"))  # `search_kb` gives `most` rows at most
    return rules.join(own, ["id", "type"]).orderBy(F.col("score").desc(), "id")


def explain(rules: DataFrame, chunks: DataFrame, query: str, id_col: str = "chunk_id", k: int = 3) -> DataFrame:
    """(part, id, score): the best rules and the most similar chunks (scored beforehand as `score`) for a question."""
    kb = search_kb(rules, query, k).select(F.lit("rule").alias("part"), "id", "score")
    code = top_k(chunks.select(id_col, "score"), "score", k, id_col)
    return kb.unionByName(code.select(F.lit("code").alias("part"), F.col(id_col).cast("string").alias("id"), "score"))


def gather(rules: DataFrame, methods: DataFrame, chunks: DataFrame, query: str, id_col: str = "chunk_id") -> DataFrame:
    """(part, ord, line): what a task is given: three patterns, the first five critical antipatterns, ten methods and three
    similar chunks, one line each."""
    patterns = search_kb(rules, query, 3, "pattern").select(F.lit("pattern").alias("part"), F.col("score").alias("s"), F.concat_ws(": ", "id", "title").alias("line"))
    critical = rules.where("type = 'antipattern' and severity = 'critical'").orderBy("id").limit(5).select(F.lit("antipattern").alias("part"), F.lit(0.0).alias("s"), F.concat_ws(": ", "id", "title").alias("line"))
    api = methods.orderBy("ref", "name").limit(10).select(F.lit("method").alias("part"), F.lit(0.0).alias("s"), F.concat_ws(".", "ref", "name").alias("line"))
    code = top_k(chunks.select(id_col, "score"), "score", 3, id_col).select(F.lit("code").alias("part"), F.col("score").alias("s"), F.col(id_col).cast("string").alias("line"))
    from pyspark.sql import Window

    rows = patterns.unionByName(critical).unionByName(api).unionByName(code)  # at most 21 rows
    return rows.select("part", F.row_number().over(Window.partitionBy("part").orderBy(F.col("s").desc(), "line")).alias("ord"), "line")


def data_status(registry: DataFrame, indexes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(name, version, index, present, fresh): for each registered configuration and each wanted index, whether it is there
    and as new as its sources. `indexes` has (name, version, index, index_time, source_time)."""
    every = registry.select("name", "version", F.explode(F.lit(list(wanted))).alias("index"))
    both = every.join(indexes, ["name", "version", "index"], "left")
    fresh = F.col("index_time").isNotNull() & (F.col("source_time").isNull() | (F.col("index_time") >= F.col("source_time")))
    return both.select("name", "version", "index", F.col("index_time").isNotNull().alias("present"), fresh.alias("fresh"))
