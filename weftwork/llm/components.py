"""Connected components of an edge table, without collecting it.

Each partition first runs union-find over its own edges and keeps only a spanning forest (at most one edge a node). The
forests are then contracted by hooking every node to its smallest neighbour, in rounds of joins; hot nodes are only ever
aggregated (partial aggregation) or joined (adaptive execution splits them), never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release


class UnionFind:
    """Disjoint sets with path halving; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(most_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()

        def out() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(sets.up) if (r := sets.root(x)) != x]
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.union(a, b)
            if len(sets.up) > most_nodes:  # bounded memory: hand on the stars found so far and begin anew
                yield out()
                sets.up = {}
        yield out()

    return run


def connected_components(edges: DataFrame, most_nodes: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): component is the smallest node that can be reached.

    Nulls are ignored, self-loops and repeated edges are harmless, no edges give no rows. The result is a table in the shared
    folder; the tables between are freed.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    forest = edges.where("a <> b").mapInArrow(_forest(most_nodes), "a long, b long")
    live = materialize(forest.distinct(), "forest")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("up"))
        hook = materialize(hook.select("x", F.least("x", "up").alias("up")), "hooks")
        while True:  # pointer jumping: afterwards every node points at its tree's root
            far = hook.select(F.col("x").alias("up"), F.col("up").alias("far"))
            jumped = materialize(hook.join(far, "up").select("x", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "hooks")
            release(hook)
            hook = jumped
            if jumped.where("moved").isEmpty():
                break
        step = hook.select(F.col("x").alias("component"), F.col("up").alias("to"))
        old = labels
        labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = live.join(hook.select(F.col("x").alias("a"), F.col("up").alias("ra")), "a").join(hook.select(F.col("x").alias("b"), F.col("up").alias("rb")), "b")
        rest = materialize(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "forest")
        release(old, live, hook)
        live = rest
    release(live)
    return labels
