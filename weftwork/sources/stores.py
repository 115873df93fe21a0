"""Small stores: indexes and registries as tables below a folder, rule collections from files, reports of earlier runs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import first_wins
from ..scratch import remove
from .rule_schema import schema_problems
from .versioned import current, delete_rows, read_table, replace_table, upsert_table, vacuum

# What a rule file has to hold, and what these fields can be.
REQUIRED = ("id",)
SEVERITY = ("critical", "warning", "info")
RULE_SCHEMA = (
    "id string, title string, tags array<string>, category string, severity string, description string, when_to_use string, recommendation_for_llm string, "
    "source_type string, source_code string, source_url string, regex_pattern string, flags string, ast_pattern string, linter_rule string, applicable_to array<string>"
)
#: Columns whose value lies deeper in a rule file, and the way to it.
NESTED = {
    "regex_pattern": ("detect", "regex", "pattern"),
    "flags": ("detect", "regex", "flags"),
    "ast_pattern": ("detect", "ast_pattern", "query"),
    "linter_rule": ("detect", "bsl_ls_rule", "code"),
    "source_type": ("source", "type"),
    "source_code": ("source", "code"),
    "source_url": ("source", "url"),
}
REGISTRY_SCHEMA = "name string, version string, path string, added_at timestamp, indexed_at timestamp"


def save_index(df: DataFrame, path: str) -> None:
    """Replace the index at `path`, which may be what `df` reads: the new one is written beside it and takes its place in one
    step, so that a driver lost in between leaves the old one whole."""
    replace_table(df, path)
    vacuum(df.sparkSession, path, keep=2)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at `path`, also one of plain Parquet files; None if there is none."""
    found = read_table(spark, path)
    if found is not None:
        return found
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_json(df: DataFrame, path: str) -> None:
    """Write an index as JSON files, an object a line, for readers that aren't Spark; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """An index from JSON files, by lines or as one array of objects a file; None if there is none. Lines or files that
    are no objects are left out."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    whole = text.where(F.ltrim("value").startswith("["))
    lines = text.where(~F.ltrim("value").startswith("[")).select(F.explode(F.split("value", r"\r?\n")).alias("value")).where(F.ltrim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", schema).alias("r")).unionByName(whole.select(F.explode(F.from_json("value", f"array<struct<{_as_struct(schema)}>>")).alias("r")))
    return parsed.where("r is not null").select("r.*")


def _as_struct(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def present_paths(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    """(name, path, present): which of a catalogue's paths there are; a store that can't be asked counts as absent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name, path in named.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        try:
            rows.append((name, path, bool(p.getFileSystem(conf).exists(p))))
        except Py4JJavaError:
            rows.append((name, path, False))
    return spark.createDataFrame(rows, "name string, path string, present boolean")


def drop_index(spark: SparkSession, path: str) -> None:
    remove(spark, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registered configurations; none if there is no registry yet or it can't be read."""
    found = load_index(spark, path)
    return found.select(*spark.createDataFrame([], REGISTRY_SCHEMA).columns) if found is not None else spark.createDataFrame([], REGISTRY_SCHEMA)


def register(spark: SparkSession, path: str, rows: DataFrame, replace: bool = False) -> None:
    """Add configurations. A key (name, version) that is there already is an error, or replaced; of new rows that repeat a
    key the one added last wins."""
    keys = ["name", "version"]
    known = read_registry(spark, path)
    if not replace and (twice := known.join(rows.select(*keys), keys, "left_semi").first()):
        raise ValueError(f"{twice['name']}:{twice['version']} is registered already")
    if current(spark, path) is None:
        replace_table(known, path, keys, 1)
    upsert_table(rows.select(*known.columns), path, ["added_at"])


def unregister(spark: SparkSession, path: str, name: str, version: str) -> bool:
    """Take a configuration out; whether it was there."""
    if current(spark, path) is None:
        return False
    return delete_rows(spark, path, (F.col("name") == name) & (F.col("version") == version))[1] > 0


def mark_indexed(spark: SparkSession, path: str, name: str, version: str, when: Column) -> None:
    """Note when a configuration was indexed."""
    own = read_registry(spark, path).where((F.col("name") == name) & (F.col("version") == version))
    upsert_table(own.withColumn("indexed_at", when.cast("timestamp")), path, columns=["indexed_at"])


def newest_source(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """One row: the latest change of the files below a folder, null without files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max("modificationTime").alias("source_time"))


def rule_problems(rule: object, schema: dict | None = None) -> list[str]:
    """What is wrong with a rule as it is in its file; nothing for a valid one. A schema adds its own checks."""
    if not isinstance(rule, dict):
        return ["not an object"]
    out = [f"{k} is missing" for k in REQUIRED if not isinstance(rule.get(k), str) or not rule[k]]
    if rule.get("severity") is not None and rule["severity"] not in SEVERITY:
        out.append(f"severity is {rule['severity']!r}")
    for k in ("tags", "applicable_to"):
        if not isinstance(rule.get(k, []), list) or not all(isinstance(x, str) for x in rule.get(k, [])):
            out.append(f"{k} is no list of texts")
    if isinstance(rule.get("regex_pattern"), str):
        try:
            re.compile(rule["regex_pattern"])
        except re.error as e:
            out.append(f"regex_pattern: {e}")
    return out + list(schema_problems(rule, schema) if schema else ())


def rule_columns(rule: dict) -> dict[str, object]:
    """A rule's fields by the columns of the table: nested ones are lifted; a field that is no text counts as absent, but
    numbers of a source are texts."""
    out = dict(rule)
    for column, way in NESTED.items():
        value: object = rule
        for step in way:
            value = value.get(step) if isinstance(value, dict) else None
        if value is not None and not isinstance(value, (dict, list)):
            out[column] = str(value)
    return {k: v for k, v in out.items() if isinstance(v, (str, list))}


def _parse(text: str, path: str) -> object:
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("rule files in YAML need the yaml module") from e
    return yaml.safe_load(text)


def _rules(schema: dict | None):
    def run(batches: Iterable):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["value"], strict=True):
                try:
                    rule = _parse(text, path)
                    problems = rule_problems(rule, schema)
                except Exception as e:  # any fault of a parser is that file's problem, told in its row
                    rule, problems = None, [f"not readable: {type(e).__name__}"]
                rows.append((path, json.dumps(rule_columns(rule), ensure_ascii=False, default=str) if not problems else None, "; ".join(problems) or None))
            yield pd.DataFrame(rows, columns=["path", "rule", "problem"])

    return run


def read_schemas(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The schemas `<collection>.schema.json` of a folder, by collection; one that is no JSON is left out. They are few."""
    files = spark.read.option("pathGlobFilter", "*.schema.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    out = {}
    for r in files.collect():
        try:
            out[r["name"].removesuffix(".schema.json")] = json.loads(r["value"])
        except ValueError:
            continue
    return out


def read_rules(spark: SparkSession, folders: dict[str, str], schemas: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, problems): the rules of each collection (type -> folder of JSON or YAML files), one a file, by path; of rules
    of one collection that repeat an id the last by path wins. Files that can't be read, lack a field or don't fit their
    collection's schema are in `problems` (path, problem) alone. The expression of a rule is that of `detect.regex`."""
    parts = None
    for kind, folder in folders.items():
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,yaml,yml}").text(folder, wholetext=True)
        part = files.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(_rules((schemas or {}).get(kind)), "path string, rule string, problem string").withColumn("type", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    good = parts.where("problem is null").select("type", "path", F.from_json("rule", RULE_SCHEMA).alias("r")).select("type", "path", "r.*")
    rules = first_wins(good, ["type", "id"], [F.col("path").desc()])
    return rules.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "applicable_to")}), parts.where("problem is not null").select("path", "problem")


def catalogue(text: str, environment: dict[str, str], names: Sequence[str] = ()) -> dict[str, str]:
    """Paths from lines `NAME=value`, in which `${OTHER}` stands for another name's value; names of the environment come
    first. A name that isn't known is a KeyError, a circle a ValueError. `names` asks for some of them only."""
    own = dict(line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    own = {k.strip(): v.strip().strip("\"'") for k, v in own.items()}

    def value(name: str, above: tuple[str, ...]) -> str:
        if name in above:
            raise ValueError(f"{name} refers to itself")
        raw = environment[name] if name in environment else own[name]
        return re.sub(r"\$\{(\w+)\}", lambda m: value(m[1], (*above, name)), raw)

    return {n: value(n, ()) for n in names or own}
