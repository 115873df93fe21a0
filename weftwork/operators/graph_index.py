"""Adjacency of a graph as two kept tables: edges in folders by a hash of their source, and again by their target.

A walk reads, in each hop, only the folders of its frontier; the graph is written once and not for every question.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release

BUCKETS = 64
SIDES = {"out": ("src", "dst"), "in": ("dst", "src")}


class Adjacency(NamedTuple):
    """Where the two tables lie and how many folders each has."""

    path: str
    buckets: int

    def edges(self, spark: SparkSession, direction: str) -> DataFrame:
        """All edges with `weft_bucket`, that of their near end."""
        if direction not in SIDES:
            raise ValueError(f"direction is {direction!r}; it can be out or in")
        return spark.read.parquet(f"{self.path}/{direction}")


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def build_adjacency(edges: DataFrame, path: str, buckets: int = BUCKETS) -> Adjacency:
    """Write the edges (src, dst, ...) below `path`, a new folder. Range partitions split a node with very many edges.
    Edges with a null end stay, in the folder of the null node, which no walk asks for."""
    for direction, (near, far) in SIDES.items():
        rows = edges.withColumn("weft_bucket", _bucket(F.col(near), buckets))
        rows.repartitionByRange("weft_bucket", near, far).sortWithinPartitions("weft_bucket", near, far).write.partitionBy("weft_bucket").parquet(f"{path}/{direction}")
    return Adjacency(path, buckets)


def index_neighbours(spark: SparkSession, graph: Adjacency, node: str, direction: str = "out") -> DataFrame:
    """The edges that leave or reach a node: one folder is read, and of its files those whose range has the node."""
    near = SIDES.get(direction, ("src", "dst"))[0]
    rows = graph.edges(spark, direction)
    return rows.where((F.col("weft_bucket") == _bucket(F.lit(node), graph.buckets)) & (F.col(near) == node)).drop("weft_bucket")


def _hops(spark: SparkSession, graph: Adjacency, start: str, depth: int, direction: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each hop the edges walked and, written, the nodes (node, weft_bucket) that are new."""
    if depth < 1:
        raise ValueError("the depth has to be 1 or more")
    edges = graph.edges(spark, direction)
    near, far = SIDES[direction]
    frontier = spark.createDataFrame([(start,)], "node string").withColumn("weft_bucket", _bucket(F.col("node"), graph.buckets))
    seen: list[DataFrame] = []
    for _ in range(depth):
        folders = [r[0] for r in frontier.select("weft_bucket").distinct().collect()]  # a number for each folder at most
        if not folders:
            return
        ends = frontier.select(F.col("node").alias("weft_at"), F.col("weft_bucket").alias("weft_of"))
        there = edges.where(F.col("weft_bucket").isin(folders))
        walked = there.join(ends, (there["weft_bucket"] == ends["weft_of"]) & (there[near] == ends["weft_at"]), "left_semi").drop("weft_bucket")
        ahead = walked.where(F.col(far).isNotNull()).select(F.col(far).alias("node")).distinct()
        for hop in seen:
            ahead = ahead.join(hop.select("node"), "node", "left_anti")
        frontier = materialize(ahead.withColumn("weft_bucket", _bucket(F.col("node"), graph.buckets)), "hop")
        seen.append(frontier)
        yield walked, frontier


def index_closure(spark: SparkSession, graph: Adjacency, start: str, max_depth: int = 10, direction: str = "out") -> DataFrame:
    """(node, depth), as `graph.closure` has them: nodes within `max_depth` hops with their least depth; the start only where
    it is on a cycle; written, and freed when the driver's Python ends or `scratch.release` is told."""
    out = spark.createDataFrame([], "node string, depth int")
    hops = []
    for depth, (_, nodes) in enumerate(_hops(spark, graph, start, max_depth, direction), 1):
        hops.append(nodes)
        out = out.unionByName(nodes.select("node", F.lit(depth).alias("depth")))
    out = materialize(out.coalesce(max(1, len(hops))), "closure")
    release(*hops)
    return out


def index_closure_edges(spark: SparkSession, graph: Adjacency, start: str, max_depth: int, direction: str = "out") -> DataFrame:
    """The edges that the closure walks: those that leave the start or a node at less than `max_depth`. Written."""
    out, hops = None, []
    for walked, nodes in _hops(spark, graph, start, max_depth, direction):
        hops.append(nodes)
        out = walked if out is None else out.unionByName(walked)
    found = materialize(out, "walked")
    release(*hops)
    return found
