"""Source modules: text files with procedures and functions, as tables of modules and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import find_all
from ..operators.text import strip_line_comment

# Keywords of the source language, in its two spellings.
BEGIN = "Procedure|Function|Процедура|Функция"
END = "EndProcedure|EndFunction|КонецПроцедуры|КонецФункции"
EXPORT = "Export|Экспорт"
ASYNC = "Async|Асинх"
NAME = r"[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*"


def read_modules(spark: SparkSession, folder: str, pattern: str = "*.bsl") -> DataFrame:
    """(path, text) of every module below a folder, without a leading byte-order mark."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def methods(modules: DataFrame) -> DataFrame:
    """(path, name, is_function, is_export, is_async, parameters, start_line, end_line): a method ends at the next end mark, or where
    it starts if there is none. Keywords are matched without regard to case."""
    head = rf"^[\t ]*(?:(?:{ASYNC})[\t ]+)?(?:{BEGIN})[\t ]+{NAME}[\t ]*\([^)]*\)[^\n]*"
    starts = find_all(modules, "path", "text", head, "mi")
    ends = find_all(modules, "path", "text", rf"^[\t ]*(?:{END})\b", "mi").select("path", F.col("line").alias("start_line"), F.lit(True).alias("is_end"))
    name = F.regexp_extract("match", rf"(?iu)(?:{BEGIN})[\t ]+({NAME})", 1)
    after = strip_line_comment(F.regexp_extract("match", r"(?s)\([^)]*\)(.*)$", 1))
    found = starts.select(
        "path",
        name.alias("name"),
        F.col("match").rlike(r"(?iu)^[\t ]*(?:\S+[\t ]+)?(?:Function|Функция)[\t ]").alias("is_function"),
        after.rlike(rf"(?iu)(?:{EXPORT})").alias("is_export"),
        F.col("match").rlike(rf"(?iu)^[\t ]*(?:{ASYNC})[\t ]").alias("is_async"),
        parameters(F.col("match")).alias("parameters"),
        F.col("line").alias("start_line"),
    )
    both = found.withColumn("is_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    ahead = Window.partitionBy("path").orderBy("start_line", "is_end").rowsBetween(0, Window.unboundedFollowing)
    next_end = F.first(F.when(F.col("is_end"), F.col("start_line")), ignorenulls=True).over(ahead)
    return both.withColumn("end_line", F.coalesce(next_end, "start_line")).where("not is_end").drop("is_end")


def module_records(modules: DataFrame) -> DataFrame:
    """(path, ..., line_count, methods, regions): one row a module with its other columns but the text, its methods and its
    regions (name, start_line, end_line, depth, parent) by line; empty lists where there are none. Only what was found is
    shuffled."""
    from ..operators.builders import regions
    from ..operators.text import lines

    own = methods(modules)
    listed = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", *[c for c in own.columns if c not in ("path", "start_line")]))).alias("methods"))
    found = regions(lines(modules.select("path", "text"), "path", "text"), "path")
    parts = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", "depth", "parent"))).alias("regions"))
    heads = modules.select(*[c for c in modules.columns if c != "text"], F.size(F.split("text", "\n", -1)).alias("line_count"))
    both = heads.join(listed, "path", "left").join(parts, "path", "left")
    return both.withColumns({"methods": F.coalesce("methods", F.array().cast(listed.schema["methods"].dataType)), "regions": F.coalesce("regions", F.array().cast(parts.schema["regions"].dataType))})


def parameters(found: Column) -> Column:
    """array<struct(name, by_value, default_value, has_default)> of a method's head, such as `match` of its start: split
    at commas outside parentheses and double quotes; empty without parameters."""
    inside = F.regexp_extract(found, r'(?s)\(((?:[^()"]|"[^"]*"|\((?:[^()"]|"[^"]*")*+\))*+)\)', 1)
    parts = F.regexp_extract_all(inside, F.lit(r'(?:[^,()"]|"[^"]*"|\((?:[^()"]|"[^"]*")*+\))++'), 0)
    by_value, default = r"(?iu)^(?:Val|Знач)\s+", r"(?s)^[^=]*=(.*)$"

    def one(x: Column) -> Column:
        text = F.trim(F.regexp_replace(x, r"\s+", " "))
        has = F.contains(text, F.lit("="))
        name = F.trim(F.regexp_replace(F.substring_index(text, "=", 1), by_value, ""))
        return F.struct(name.alias("name"), text.rlike(by_value).alias("by_value"), F.when(has, F.trim(F.regexp_extract(text, default, 1))).alias("default_value"), has.alias("has_default"))

    return F.filter(F.transform(parts, lambda x: one(x)), lambda x: x["name"] != "")
