"""Dependency and call graphs as edge tables: neighbours, bounded closures, impact and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release


def neighbours(edges: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Out-edges (dependencies), in-edges (dependents) or both of a node; parallel edges stay."""
    tests = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}
    if direction not in tests:
        raise ValueError(f"direction is {direction!r}; it can be out, in or both")
    return edges.where(tests[direction])


def _ends(direction: str) -> tuple[str, str]:
    if direction not in ("out", "in"):
        raise ValueError(f"direction is {direction!r}; it can be out or in")
    return ("src", "dst") if direction == "out" else ("dst", "src")


def closure(edges: DataFrame, start: str, max_depth: int = 10, direction: str = "out") -> DataFrame:
    """(node, depth): nodes within `max_depth` hops with their least depth. The start is not visited beforehand, so it
    appears where it is on a cycle. The edges are written once; each hop keeps those that leave the frontier (a semi join,
    whose small side Spark sends to the tasks where it is small) and writes the new nodes. Null ends lead nowhere."""
    if max_depth < 1:
        raise ValueError("max_depth has to be 1 or more")
    a, b = _ends(direction)
    steps = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("at"), F.col(b).alias("node")), "edges")
    hops: list[DataFrame] = []
    frontier = edges.sparkSession.createDataFrame([(start,)], "at string")
    for depth in range(1, max_depth + 1):
        ahead = steps.join(frontier, "at", "left_semi").select("node").distinct()
        for seen in hops:
            ahead = ahead.join(seen, "node", "left_anti")
        ahead = materialize(ahead, "hop")
        hops.append(ahead)
        if ahead.isEmpty():
            break
        frontier = ahead.select(F.col("node").alias("at"))
    release(steps)
    out = hops[0].select("node", F.lit(1).alias("depth"))
    for depth, hop in enumerate(hops[1:], 2):
        out = out.unionByName(hop.select("node", F.lit(depth).alias("depth")))
    return out


def closure_edges(edges: DataFrame, start: str, max_depth: int, direction: str = "out") -> DataFrame:
    """Edges walked by the closure: those that leave the start, or a node at less than `max_depth`."""
    own = _ends(direction)[0]
    inner = closure(edges, start, max_depth, direction).where(F.col("depth") < max_depth).select(F.col("node").alias(own))
    root = edges.sparkSession.createDataFrame([(start,)], f"{own} string")
    return edges.join(inner.union(root).distinct(), own, "left_semi").select(*edges.columns)


def impact_count(edges: DataFrame, node: str, max_depth: int = 10) -> DataFrame:
    """How many nodes depend on a node, directly or not."""
    return closure(edges, node, max_depth, "in").agg(F.count("*").alias("impact"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct endpoints, mean degree."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.agg(F.count_distinct("node").alias("nodes"), F.count("*").alias("ends"))
    return nodes.select("nodes", F.expr("ends div 2").alias("edges"), F.round(F.col("ends") / F.col("nodes"), 6).alias("avg_degree"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with the most edge ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "node").limit(k)


def filter_calls(calls: DataFrame, ref: str | None = None, method: str | None = None) -> DataFrame:
    """Call edges whose source or target is `ref`, and of them those whose source or target method is `method`."""
    out = calls
    if ref is not None:
        out = out.where((F.col("src") == ref) | (F.col("dst") == ref))
    if method is not None:
        out = out.where((F.col("src_method") == method) | (F.col("dst_method") == method))
    return out


def call_stats(calls: DataFrame) -> DataFrame:
    """Totals of a set of call edges: edges, distinct callers, distinct known callees."""
    return calls.agg(F.count("*").alias("total"), F.count_distinct("src").alias("callers"), F.count_distinct("dst").alias("callees"))


def resolve_calls(calls: DataFrame, modules: DataFrame, exports: DataFrame, excluded: DataFrame) -> DataFrame:
    """Calls (caller, module, method) of known modules' exported methods, without excluded names."""
    known = calls.join(modules.select("module").distinct(), "module", "left_semi").join(excluded.select("method").distinct(), "method", "left_anti")
    return known.join(exports.select("module", "method").distinct(), ["module", "method"], "left_semi")


#: Most hops of a view.
VIEW_DEPTH = 5


def dependency_view(edges: DataFrame, ref: str | None = None, direction: str = "both", depth: int = 1, most: int = 500) -> tuple[DataFrame, int, bool]:
    """(at most `most` edges in the order of their ends, how many there are, whether some are left out): the whole graph
    without `ref`, else the edges that a walk of `depth` hops (1 to `VIEW_DEPTH`) from it takes. `most` bounds the answer,
    not the walk; an unknown `ref` has no edges."""
    if not 1 <= depth <= VIEW_DEPTH:
        raise ValueError(f"the depth has to be 1 to {VIEW_DEPTH}")
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is {direction!r}; it can be out, in or both")
    if ref is None:
        found = edges
    else:
        walks = [closure_edges(edges, ref, depth, d) for d in (("out", "in") if direction == "both" else (direction,))]
        # An edge that both walks take counts once, as often as it is in the graph.
        found = walks[0] if len(walks) == 1 else walks[0].unionAll(walks[1].exceptAll(walks[0]))
    total = found.count()
    return found.orderBy(*found.columns).limit(most), total, total > most
