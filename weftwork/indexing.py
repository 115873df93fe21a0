"""All indexes of a dump in one go: objects, attributes, API reference, call graph, dependency graph and method chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import builders
from .operators.store import is_fresh
from .scratch import materialize, release
from .sources import metadata, modules, paths
from .sources.stores import load_index, mark_indexed, newest_source, read_registry, save_index

INDEXES = ("objects", "attributes", "modules", "api_reference", "call_graph", "dependency_graph", "chunks")


def index_path(target: str, name: str, version: str, index: str) -> str:
    return f"{target.rstrip('/')}/{name}/{version}/{index}"


def read_sources(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """(objects, modules) of a dump; modules with their name, ref and kind from their place below the folder."""
    found = modules.read_modules(spark, source)
    place = paths.relative(F.col("path"), source)
    info = paths.module_info(place)
    return metadata.read_objects(spark, source, recover=True), found.select("path", "text", paths.module_name(place).alias("module"), info["ref"].alias("ref"), info["kind"].alias("kind"))


def indexes(objects: DataFrame, code: DataFrame, prefix: str) -> dict[str, DataFrame]:
    """The plan of each index over (objects, modules) as `read_sources` gives them. Objects without
    anything to read stay in the index of objects, without properties."""
    found = modules.methods(code)
    exports = found.where("is_export").join(code.select("path", "module"), "path").select("module", F.col("name").alias("method"))
    attributes = metadata.attributes(objects)
    named = objects.select("type", "name", "path", *[c for c in ("well_formed", "repairs") if c in objects.columns]).join(metadata.properties(objects).drop("type", "name"), "path", "left")
    return {
        "objects": named,
        "attributes": attributes,
        "modules": code,
        "api_reference": builders.api_reference(found, code),
        "call_graph": builders.call_graph(code, exports, builders.call_sites(code)),
        "dependency_graph": builders.dependency_graph(attributes),
        "chunks": builders.method_chunks(code, found, prefix),
    }


def build(spark: SparkSession, source: str, target: str, name: str, version: str) -> dict[str, int]:
    """Write every index of one dump and give its number of rows. Sources are read once, into the shared folder."""
    objects, code = (materialize(x, "sources") for x in read_sources(spark, source))
    sizes = {}
    for index, plan in indexes(objects, code, f"{name}_{version}").items():
        path = index_path(target, name, version, index)
        save_index(plan, path)
        sizes[index] = load_index(spark, path).count()
    release(objects, code)
    return sizes


def fresh(spark: SparkSession, registry: str) -> DataFrame:
    """(name, version, path, indexed_at, source_time, fresh) of every registered dump. A registry has few rows, each a folder
    whose files are listed."""
    parts = None
    for r in read_registry(spark, registry).collect():
        one = newest_source(spark, r["path"]).select(F.lit(r["name"]).alias("name"), F.lit(r["version"]).alias("version"), F.lit(r["path"]).alias("path"), F.lit(r["indexed_at"]).cast("timestamp").alias("indexed_at"), "source_time")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "name string, version string, path string, indexed_at timestamp, source_time timestamp, fresh boolean")
    return parts.withColumn("fresh", is_fresh(F.col("indexed_at"), F.col("source_time")))


def build_registered(spark: SparkSession, registry: str, target: str, name: str, version: str | None = None, force: bool = False) -> dict[str, dict[str, int] | None]:
    """Build the indexes of the registered versions of a dump, or of one, and note when; None for those that are fresh, which
    are left alone unless `force`. A dump that isn't registered is a KeyError."""
    wanted = fresh(spark, registry).where(F.col("name") == name)
    if version is not None:
        wanted = wanted.where(F.col("version") == version)
    rows = sorted(wanted.collect(), key=lambda r: r["version"])
    if not rows:
        raise KeyError(name if version is None else f"{name}:{version}")
    out: dict[str, dict[str, int] | None] = {}
    for r in rows:
        missing = any(load_index(spark, index_path(target, name, r["version"], i)) is None for i in INDEXES)
        if r["fresh"] and not missing and not force:
            out[r["version"]] = None
            continue
        # The time before the build, so that a source that changes during it makes the indexes stale.
        begun = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
        out[r["version"]] = build(spark, r["path"], target, name, r["version"])
        mark_indexed(spark, registry, name, r["version"], F.lit(begun))
    return out
