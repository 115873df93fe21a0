"""How many nodes depend on each node, for all nodes at once: the nodes themselves while they are few, and distinct-count
sketches beyond, passed along the edges in rounds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .graph import closure

#: Size of a sketch: 2^12 cells, 4 KB at most, with a standard error of about 1.6 %.
LOG_CELLS = 12
#: Up to so many dependents are counted exactly. Sketches can't: two names may fall on one cell however few there are.
EXACT = 100


def impact_estimates(edges: DataFrame, max_depth: int = 10, log_cells: int = LOG_CELLS, exact: int = EXACT) -> DataFrame:
    """(node, impact, settled): how many nodes reach a node over at most `max_depth` edges, itself only where it is on a
    cycle; `settled` is false if a further round could still add some. Written. Numbers up to `exact` are right, and an
    estimate is always beyond it.

    A round joins the edges with what is known of their sources and merges it by target, with partial merges before the
    shuffle; one job a hop serves all nodes. A node with more sources than `exact`, or behind one that has more dependents,
    has more itself; it collects no names, so that no group has more than `exact` squared. Nodes on which nothing depends have
    0; null ends lead nowhere.
    """
    pairs = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    wide = pairs.groupBy("dst").agg(F.count("*").alias("sources")).where(F.col("sources") > exact)
    steps = materialize(pairs.join(wide, "dst", "left").select("src", "dst", F.col("sources").isNull().alias("narrow")), "edges")
    release(pairs)
    nodes = steps.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    few = F.when(F.bool_and("narrow"), F.collect_list(F.when(F.col("narrow"), F.col("src"))))
    now = materialize(steps.groupBy(F.col("dst").alias("node")).agg(F.hll_sketch_agg("src", log_cells).alias("sketch"), few.alias("few")), "known")
    grows = True
    for _ in range(max_depth - 1):
        passed = steps.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "sketch", F.when(F.col("narrow"), F.col("few")).alias("few"))
        merged = now.unionByName(passed).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch"), F.bool_and(F.col("few").isNotNull()).alias("all_few"), F.array_distinct(F.flatten(F.collect_list("few"))).alias("few"))
        ahead = materialize(merged.select("node", "sketch", F.when(F.col("all_few") & (F.array_size("few") <= exact), F.col("few")).alias("few")), "known")
        size = lambda name: F.struct(F.coalesce(F.array_size("few"), F.lit(exact + 1)).alias("names"), F.when(F.col("few").isNull(), F.hll_sketch_estimate("sketch")).alias("guess")).alias(name)
        both = ahead.select("node", size("more")).join(now.select("node", size("less")), "node", "left")
        grows = not both.where("less is null or more.names > less.names or more.guess > less.guess").isEmpty()
        release(now)
        now = ahead
        if not grows:
            break
    counted = now.select("node", F.coalesce(F.array_size("few"), F.greatest(F.hll_sketch_estimate("sketch"), F.lit(exact + 1))).alias("impact"))
    out = materialize(nodes.join(counted, "node", "left").select("node", F.coalesce("impact", F.lit(0)).cast("long").alias("impact"), F.lit(not grows).alias("settled")), "impact")
    release(steps, now)
    return out


def checked_impact(edges: DataFrame, estimates: DataFrame, sample: Iterable[str], max_depth: int = 10) -> DataFrame:
    """(node, impact, exact): the estimates of a few stated nodes beside exact closures, one walk each."""
    out = None
    for node in sample:
        n = closure(edges, node, max_depth, "in").agg(F.count("*").alias("exact")).select(F.lit(node).alias("node"), "exact")
        out = n if out is None else out.unionByName(n)
    if out is None:
        return estimates.limit(0).select("node", "impact", F.lit(0).cast("long").alias("exact"))
    return estimates.select("node", "impact").join(F.broadcast(out), "node")  # the stated nodes
