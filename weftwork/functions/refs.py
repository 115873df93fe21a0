"""References, versions and other small scalar parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_ref(ref: Column) -> Column:
    """struct(type, name), split at the first dot; null where a part is missing."""
    parts = F.split(ref, "\\.", 2)
    ok = (F.size(parts) == 2) & (parts[0] != "") & (F.element_at(parts, -1) != "")
    return F.when(ok, F.struct(parts[0].alias("type"), F.element_at(parts, -1).alias("name")))


def version_struct(text: Column) -> Column:
    """struct(major, minor, patch, build), comparable; null with fewer than three numbers; a missing build is 0."""
    parts = F.transform(F.split(text, "\\."), lambda x: x.try_cast("int"))
    build = F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit(0))
    ok = (F.size(parts) >= 3) & ~F.exists(F.slice(parts, 1, 3), lambda x: x.isNull())
    return F.when(ok, F.struct(F.try_element_at(parts, F.lit(1)).alias("major"), F.try_element_at(parts, F.lit(2)).alias("minor"), F.try_element_at(parts, F.lit(3)).alias("patch"), build.alias("build")))


def available_in(flags: Column, env: Column) -> Column:
    """A context's flag in a map; unknown contexts are false."""
    return F.coalesce(F.try_element_at(flags, env), F.lit(False))


def mask_dsn(dsn: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(dsn, r"(://[^:/@]+:)[^@]*@", "$1***@")


def plan_id_valid(plan: Column) -> Column:
    return plan.rlike(r"^[a-zA-Z0-9_-]{1,128}$")


def artifact_ref(text: Column) -> Column:
    """struct(plan, number) of `plan#number`, split at the last #; null unless the number is 1 or more."""
    plan, number = F.regexp_extract(text, r"^(.*)#([0-9]+)$", 1), F.regexp_extract(text, r"^(.*)#([0-9]+)$", 2).try_cast("int")
    return F.when(number >= 1, F.struct(plan.alias("plan"), number.alias("number")))


def diff_stat(summary: Column) -> Column:
    """struct(files, insertions, deletions) of the last line of a diff summary; missing numbers are 0."""
    def n(p: str) -> Column:
        return F.coalesce(F.regexp_extract(summary, p, 1).try_cast("int"), F.lit(0))

    return F.struct(n(r"([0-9]+) files? changed").alias("files"), n(r"([0-9]+) insertions?\(\+\)").alias("insertions"), n(r"([0-9]+) deletions?\(-\)").alias("deletions"))


def branch_valid(name: Column) -> Column:
    """A safe relative branch or path name."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~F.contains(name, F.lit(".."))


def repository_valid(name: Column) -> Column:
    """`owner/name` of letters, digits, dots, dashes and underscores."""
    return name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~F.contains(name, F.lit(".."))


def inside_root(path: Column) -> Column:
    """A relative path that doesn't leave its root."""
    return (path != "") & ~path.rlike(r"^(/|\\\\|[A-Za-z]:)") & ~F.exists(F.split(path, r"[/\\\\]"), lambda p: p == "..")


def vector_literal(v: Column) -> Column:
    """A vector as text, `[a,b,c]`."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def vector_parse(text: Column) -> Column:
    """The vector behind its text; null where a part is no number."""
    parts = F.transform(F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"\s*,\s*"), lambda x: x.try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def generated_path(type_: Column, name: Column, task: Column, turn: Column) -> Column:
    """Where a generated module goes: the object's own module file, else a file of the task and turn."""
    has = F.coalesce(name, F.lit("")) != ""
    return (
        F.when((type_ == "CommonModule") & has, F.concat(F.lit("CommonModules/"), name, F.lit("/Ext/Module.bsl")))
        .when((type_ == "Catalog") & has, F.concat(F.lit("Catalogs/"), name, F.lit("/Ext/ObjectModule.bsl")))
        .when((type_ == "Document") & has, F.concat(F.lit("Documents/"), name, F.lit("/Ext/ObjectModule.bsl")))
        .otherwise(F.concat(F.lit("Generated/"), task.cast("string"), F.lit("_"), turn.cast("string"), F.lit(".bsl")))
    )
