"""Import boundaries: which lines of a package's sources import what the package must not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lines


def forbidden_imports(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, package, line_no, module, forbidden): import lines of `sources` (path, package, text) against `rules` (package,
    prefix). A prefix forbids the module itself and all below it; comments are no imports. Each import is looked up by all
    its own prefixes, so that the join is an equality."""
    rows = lines(sources.select(F.struct("path", "package").alias("file"), "text"), "file", "text")
    module = F.regexp_extract(F.trim("line"), r"^(?:from|import)\s+([\w.]+)", 1)
    found = rows.select("file.path", "file.package", "line_no", module.alias("module")).where("module <> ''")
    parts = F.split("module", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    asked = found.withColumn("forbidden", F.explode(prefixes))
    return asked.join(rules.select("package", F.col("prefix").alias("forbidden")).distinct(), ["package", "forbidden"]).select("path", "package", "line_no", "module", "forbidden")
