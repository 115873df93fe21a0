"""Upkeep of the call and dependency graphs: changed files in, edge changes out, without reading the other texts again.

What was read off each file lies in versioned tables in buckets by its path: the module's names, its exported methods, its call
sites and its edges. A change replaces the rows of the changed paths; edges of other files are made anew only where a module's
name came or went, or where a module of the same name changed its exports, and then from their call sites, not their texts.
The names are replaced last: a change whose driver was lost can be applied again and gives the same graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scratch import materialize, release
from ..sources.modules import methods
from ..sources.versioned import read_table, replace_keys, replace_table
from . import builders

TABLES = ("modules", "exports", "sites", "edges")
EDGE = ("src", "src_method", "dst", "dst_method", "line_no")


def _read_off(code: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, exports, call sites) of modules (path, text, module, ref, kind); the only step that reads texts."""
    names = code.select("path", "module", "ref")
    exports = methods(code).where("is_export").join(code.select("path", "module"), "path").select("path", "module", F.col("name").alias("method"))
    return names, exports, builders.call_sites(code)


def _edges(names: DataFrame, exports: DataFrame, sites: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, edge columns) of all files, or of some paths, from what was read off."""
    own = sites if paths is None else sites.join(paths, "path", "left_semi")
    # The graph names its source by ref; refs are looked up by path beside it, so that an edge can be replaced with its file.
    keyed = names.select("path", "module", F.col("path").alias("ref")).distinct()
    found = builders.call_graph(keyed, exports, own).withColumnRenamed("src", "path")
    return found.join(names.select("path", F.col("ref").alias("src")), "path").select("path", *EDGE)


def build_graph(code: DataFrame, root: str, buckets: int = 16) -> None:
    """Read all modules (path, text, module, ref) and write the tables below `root`, in place of what lies there."""
    kept = [materialize(t, "graph") for t in _read_off(code)]
    names, exports, sites = kept
    for table, rows in zip(TABLES, (names, exports, sites, _edges(names, exports, sites)), strict=True):
        replace_table(rows, f"{root}/{table}", ["path"], buckets)
    release(*kept)


def read_graph(spark: SparkSession, root: str) -> DataFrame:
    """(src, src_method, dst, dst_method, line_no): the edges as `builders.call_graph` has them."""
    return read_table(spark, f"{root}/edges").select(*EDGE)


def _without(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths, "path", "left_anti")


def update_graph(changed: DataFrame, root: str, removed: DataFrame | None = None) -> DataFrame:
    """Apply added and changed modules (path, text, module, ref), and paths that are gone, to the graph below `root`.

    Gives the edge changes (`change` is + or -, path, edge columns), written. Of the texts only those of `changed` are read.
    Applying the same change again gives no changes.
    """
    spark = changed.sparkSession
    new = [materialize(t, "changed") for t in _read_off(changed)]
    names, exports, sites = new
    own = changed.select("path")
    gone = materialize((own if removed is None else own.unionByName(removed.select("path"))).distinct(), "paths")
    before = {t: read_table(spark, f"{root}/{t}") for t in TABLES}
    after = {t: _without(before[t], gone).unionByName(rows) for t, rows in zip(TABLES, new, strict=False)}
    # Names that only one of both versions has, and modules whose exports aren't the same, by name.
    lost, found = (x.join(gone, "path", "left_semi").select("module").distinct() for x in (before["modules"], after["modules"]))
    known, there = (after["modules"].select("module").distinct(), before["modules"].select("module").distinct())
    moved = lost.join(known, "module", "left_anti").union(found.join(there, "module", "left_anti"))
    callers = after["sites"].join(moved.withColumnRenamed("module", "object"), "object", "left_semi").select("path")
    same = after["modules"].join(lost.union(found).distinct(), "module", "left_semi").select("path")
    touched = materialize(callers.union(same).union(gone).distinct(), "touched")
    edges = materialize(_edges(after["modules"], after["exports"], after["sites"], touched), "edges")
    old = before["edges"].join(touched, "path", "left_semi").select("path", *EDGE)
    plus, minus = edges.exceptAll(old), old.exceptAll(edges)
    delta = materialize(plus.select(F.lit("+").alias("change"), "*").unionByName(minus.select(F.lit("-").alias("change"), "*")), "delta")
    replace_keys(exports, f"{root}/exports", gone)
    replace_keys(sites, f"{root}/sites", gone)
    replace_keys(edges, f"{root}/edges", touched)
    replace_keys(names, f"{root}/modules", gone)
    release(*new, gone, touched, edges)
    return delta


def update_stream(code: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of added and changed modules (path, text, module, ref) batch by batch, then stop. A batch that is run
    again after a failure replaces the same rows; of a path that comes twice in a batch the row with the greater text counts."""

    def apply(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("path", "text")]
        last = batch.groupBy("path").agg(F.max(F.struct("text", *rest)).alias("m")).select("path", "m.*")
        kept = materialize(last, "batch")
        release(update_graph(kept, root), kept)

    return code.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_dependencies(attributes: DataFrame, root: str, removed: DataFrame | None = None) -> None:
    """Replace the dependency edges (path, src, dst, edge_type, detail) of changed objects, whose attributes have their `path`,
    in the table below `root`, which is made if there is none. An object's edges depend on its own file alone."""
    spark = attributes.sparkSession
    path = F.concat_ws(".", "type", "name")
    edges = builders.dependency_graph(attributes)
    own = edges.join(attributes.select(path.alias("src"), "path").distinct(), "src").select("path", "src", "dst", "edge_type", "detail")
    if read_table(spark, f"{root}/dependencies") is None:
        replace_table(edges.limit(0).select(F.lit("").alias("path"), "*"), f"{root}/dependencies", ["path"])
    gone = attributes.select("path") if removed is None else attributes.select("path").unionByName(removed.select("path"))
    replace_keys(own, f"{root}/dependencies", gone.distinct())
