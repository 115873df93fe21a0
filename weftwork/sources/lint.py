"""Linter results: JSON reports as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import severity

_ISSUE = "struct<code:string, severity:string, message:string, source:string, range:struct<start:struct<line:int, character:int>>, location:struct<line:int, column:int, start:struct<line:int, character:int>>>"
_REPORT = f"struct<fileinfos:array<struct<path:string, diagnostics:array<{_ISSUE}>>>>"


def parse_reports(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """(path, code, severity, message, line, column) of every diagnostic of the reports in a text column, in both forms: an
    object with files, or an array of issues. Lines and columns count from 1; a missing code is UNKNOWN. Reports that can't
    be parsed give no rows."""
    text = F.trim(text_col)
    files = F.from_json(text, _REPORT)["fileinfos"]
    of_files = F.flatten(F.transform(files, lambda f: F.transform(F.coalesce(f["diagnostics"], F.array().cast(f"array<{_ISSUE}>")), lambda d: F.struct(f["path"].alias("path"), d.alias("d")))))
    plain = F.transform(F.from_json(text, f"array<{_ISSUE}>"), lambda d: F.struct(d["source"].alias("path"), d.alias("d")))
    issues = rows.select(F.explode(F.when(text.startswith("["), plain).otherwise(of_files)).alias("x")).select("x.path", "x.d").where("d is not null")
    start, place = F.col("d.range.start"), F.col("d.location")
    line = F.coalesce(start["line"], place["start"]["line"], place["line"], F.lit(0))
    column = F.coalesce(start["character"], place["start"]["character"], place["column"], F.lit(0))
    return issues.select("path", F.coalesce("d.code", F.lit("UNKNOWN")).alias("code"), severity(F.col("d.severity")).alias("severity"), F.coalesce("d.message", F.lit("")).alias("message"), (line + 1).alias("line"), (column + 1).alias("column"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """`parse_reports` of the files at a path."""
    return parse_reports(spark.read.text(path, wholetext=True))
