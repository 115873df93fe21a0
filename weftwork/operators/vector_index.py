"""An index of vectors by centroids (inverted file): rows in a folder for each centroid, and searches that read the nearest folders.

Centroids come from MLlib's k-means on a bounded sample of unit vectors; every row is then indexed. The table of centroids keeps
for each list how far its rows are from it at most, so that an exact search can tell which other lists may still hold a hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .search import DIGITS, norm, scored_vectors, top_k

LISTS_MOST, SAMPLE_A_LIST, FILE_ROWS, SEED = 1024, 256, 1 << 19, 11
#: Rows and queries of a block; pairs handed to Spark at once; what products of matrices can differ by from sums in order.
BLOCK, PAIRS, SLACK = 1024, 8192, 1e-8
#: Vectors without a direction (all zeros, or with a null, infinite or NaN part) or of another length are in a list of their own, which every search reads.
REST = -1


class VectorIndex(NamedTuple):
    """Where the index lies, its columns, and for each list its unit centroid, rows and the least cosine of a row with it."""

    path: str
    id_col: str
    vector_col: str
    lists: dict[int, tuple[list[float], int, float]]

    def rows(self, spark: SparkSession) -> DataFrame:
        """All indexed rows with `weft_list`, the column by which the table is laid out."""
        return spark.read.parquet(f"{self.path}/rows")


def _unit(vector: Column) -> Column:
    size = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / size)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def list_count(rows: int) -> int:
    """The square root of the rows, `LISTS_MOST` at most."""
    return max(1, min(LISTS_MOST, round(math.sqrt(rows))))


def build_index(df: DataFrame, id_col: str, vector_col: str, path: str, lists: int | None = None, sample_a_list: int = SAMPLE_A_LIST) -> VectorIndex:
    """Index all rows of `df` that have a vector below `path`, a new folder.

    k-means is fitted on about `sample_a_list` rows a list; all rows are then given to their nearest centroid. A list that
    holds many rows, such as one with a frequent vector, is written by several tasks. Columns may not be named `weft_list`.
    """
    spark = df.sparkSession
    known = df.where(F.col(vector_col).isNotNull())
    width = known.groupBy(F.size(vector_col).alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).first()
    size = norm(F.col(vector_col))
    plain = F.coalesce((F.size(vector_col) == (width["w"] if width else 0)) & (size > 0) & (size < math.inf), F.lit(False))
    n = width["n"] if width else 0
    lists = min(lists or list_count(n), LISTS_MOST)
    share = min(1.0, lists * sample_a_list / max(1, n))
    usable = known.where(plain)
    sample = materialize((usable if share == 1.0 else usable.sample(share, SEED)).select(_unit(F.col(vector_col)).alias("u")), "sample")
    centres: list[list[float]] = []
    if not sample.isEmpty():
        model = KMeans(k=lists, seed=SEED, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("u").alias("f")))
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        named = usable.withColumn("weft_features", array_to_vector(_unit(F.col(vector_col))))
        named = model.setFeaturesCol("weft_features").setPredictionCol("weft_list").transform(named).drop("weft_features")
        placed = named.unionByName(known.where(~plain).withColumn("weft_list", F.lit(REST)))
    else:
        placed = known.withColumn("weft_list", F.lit(REST))
    release(sample)
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("weft_list").agg(F.count("*").alias("rows"))
    salts = {r["weft_list"]: -(-r["rows"] // FILE_ROWS) for r in sizes.collect()}  # LISTS_MOST + 1 rows at most
    salt = F.pmod(F.xxhash64(id_col), F.element_at(F.create_map(*[F.lit(x) for p in salts.items() for x in p]), F.col("weft_list"))) if salts else F.lit(0)
    placed.repartition(F.col("weft_list"), salt).write.partitionBy("weft_list").parquet(f"{path}/rows")
    unit = [[x / (math.sqrt(sum(y * y for y in c)) or 1.0) for x in c] for c in centres]
    centre = F.element_at(F.lit(unit), F.col("weft_list") + 1) if unit else F.lit(None).cast("array<double>")
    near = F.when(F.col("weft_list") != REST, _dot(_unit(F.col(vector_col)), centre))
    table = placed.groupBy("weft_list").agg(F.count("*").alias("rows"), F.min(near).alias("least")).withColumn("centre", F.when(F.col("weft_list") != REST, centre))
    table.withColumns({"id_col": F.lit(id_col), "vector_col": F.lit(vector_col)}).coalesce(1).write.parquet(f"{path}/lists")
    release(placed)
    return open_index(spark, path, id_col, vector_col)


def open_index(spark: SparkSession, path: str, id_col: str | None = None, vector_col: str | None = None) -> VectorIndex:
    """An index that `build_index` wrote. Its lists, a bounded number, are read by the driver."""
    lists = spark.read.parquet(f"{path}/lists").collect()
    if lists:
        id_col, vector_col = lists[0]["id_col"], lists[0]["vector_col"]
    return VectorIndex(path, id_col or "", vector_col or "", {r["weft_list"]: (list(r["centre"] or ()), r["rows"], r["least"]) for r in lists})


def _probed(index: VectorIndex, query: Sequence[float], probes: int) -> tuple[list[int], dict[int, float]]:
    """The lists nearest to a query, with the rest, and for each other one the greatest cosine that a row of it can have."""
    size = math.sqrt(sum(x * x for x in query)) or 1.0
    angle = {n: math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(query, c, strict=False)) / size))) for n, (c, _, _) in index.lists.items() if n != REST}
    near = sorted(angle, key=lambda n: (angle[n], n))
    bound = {n: math.cos(max(0.0, angle[n] - math.acos(max(-1.0, min(1.0, index.lists[n][2]))))) for n in near[probes:]}
    return near[:probes] + [REST] * (REST in index.lists), bound


def index_search(spark: SparkSession, index: VectorIndex, query: Sequence[float], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """The k rows of the `probes` nearest lists with the highest cosine `score`, ties by id.

    With `exact`, the k-th score of these says which of the other lists can still hold a better row or an equal one; they are
    read too, and the result is that of a search over all rows. Either way the scan reads only the folders it names.
    """
    if not index.lists:
        raise ValueError("the index has no rows")

    def hits(lists: list[int]) -> DataFrame:
        return top_k(scored_vectors(index.rows(spark).where(F.col("weft_list").isin(lists)), index.vector_col, query), "score", k, index.id_col)

    first, bound = _probed(index, query, probes)
    if exact:
        scores = [r["score"] for r in hits(first).select("score").collect()]  # k rows
        worst = scores[-1] if len(scores) == k else -2.0
        first += [n for n, most in bound.items() if most >= worst - 10.0**-DIGITS]
    return hits(first).drop("weft_list")


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, filled up with zeros, and which of them a product says nothing of: with nulls, infinite or NaN."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).cast(pa.float64())
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.where(size > 0, out / size, 0.0)
    odd = ~np.isfinite(size[:, 0]) | ~np.isfinite(out).all(axis=1)
    out[odd] = 0.0
    return out, odd


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the (query, row) pairs that can be among the k nearest: those from the k-th score less `SLACK`."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, held = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
            asks, rows = asked.field("asked"), held.field("vector")
            width = max(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (asks, rows))
            (a, odd_a), (b, odd_b) = _matrix(asks, width), _matrix(rows, width)
            score = a @ b.T
            score[odd_a] = math.inf
            score[:, odd_b] = math.inf
            # Rows that are the query itself come last and are left out.
            names = pa.concat_arrays([asked.field("query"), held.field("id")]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            score[names[: len(a), None] == names[None, len(a) :]] = -math.inf
            # Pairs without a known score may have any: they stay, and don't count among the k.
            known = np.where(np.isinf(score), -math.inf, score)
            least = np.partition(known, len(b) - k, axis=1)[:, len(b) - k, None] if len(b) > k else np.full((len(a), 1), -math.inf)
            q, r = np.nonzero((score >= least - SLACK) & (score > -math.inf))
            for at in range(0, len(q), PAIRS):
                x, y = (pa.array(v[at : at + PAIRS]) for v in (q, r))
                yield pa.RecordBatch.from_arrays([asked.field("query").take(x), asks.take(x), asked.field("list_rank").take(x), held.field("id").take(y), rows.take(y)], names=["query", "asked", "list_rank", "id", "vector"])


def index_neighbours(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = 8, id_col: str | None = None, vector_col: str | None = None) -> DataFrame:
    """(query, id, score, list_rank, rank): for each row of `queries` its k nearest indexed rows but itself, out of its
    `probes` nearest lists; None reads all lists and is exact. `list_rank` says how near a hit's list is (from 0; -1 for the
    rest). Blocks of queries meet blocks of rows by a join on the list, whose hot lists Spark splits; of each pair of blocks a
    product of matrices keeps the rows that can be among a query's k, which are then scored one by one."""
    spark = queries.sparkSession
    id_col, vector_col = id_col or index.id_col, vector_col or index.vector_col
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("asked")).where(F.col("asked").isNotNull())
    names = sorted(n for n in index.lists if n != REST)
    every = F.array().cast("array<int>")
    if names:
        centres = F.lit([[float(n), *index.lists[n][0]] for n in names])
        near = F.transform(centres, lambda c: F.struct((-_dot(F.slice(c, 2, len(index.lists[names[0]][0])), F.col("asked"))).alias("far"), c[0].cast("int").alias("list")))
        every = F.transform(F.slice(F.array_sort(near), 1, probes or len(names)), lambda s: s["list"])
    spread = asked.select("query", "asked", F.posexplode(F.concat(F.array(F.lit(REST)), every)).alias("list_rank", "weft_list")).withColumn("list_rank", F.col("list_rank") - 1)
    rows = index.rows(spark).select("weft_list", F.col(index.id_col).alias("id"), F.col(index.vector_col).alias("vector"))
    parts = F.element_at(F.create_map(*[F.lit(x) for n, (_, size, _) in index.lists.items() for x in (n, -(-size // BLOCK))]), F.col("weft_list")) if index.lists else F.lit(1)
    held = rows.groupBy("weft_list", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(F.collect_list(F.struct("id", "vector")).alias("held"))
    shares = max(1, -(-asked.count() // BLOCK))
    bundles = spread.groupBy("weft_list", F.pmod(F.xxhash64("query"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct("query", "asked", "list_rank")).alias("bundle"))
    of = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    met = bundles.join(held, "weft_list").select("bundle", "held")
    both = met.mapInArrow(lambda batches: _nearest(batches, k), f"query {of['query']}, asked {of['asked']}, list_rank int, id {of['id']}, vector {of['vector']}")
    size = norm(F.col("vector")) * norm(F.col("asked"))
    dot = F.aggregate(F.zip_with("vector", "asked", lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query", "id", "list_rank", F.round(F.when(size > 0, dot / size).otherwise(F.lit(0.0)), DIGITS).alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_for(queries: DataFrame, index: VectorIndex, k: int, share: float = 0.95) -> int:
    """How many lists a search has to read to find `share` of the exact neighbours of these queries, a bounded sample: of the
    ranks of the lists that hold them the one that this share doesn't pass."""
    ranks = index_neighbours(queries, index, k, None).groupBy("list_rank").agg(F.count("*").alias("n")).orderBy("list_rank").collect()  # a row a list at most
    wanted, upto = share * sum(r["n"] for r in ranks), 0
    for r in ranks:
        upto += r["n"]
        if upto >= wanted:
            return max(1, r["list_rank"] + 1)
    return 1


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: how many (query, id) pairs were wanted, how many of them were found, and their share."""
    both = wanted.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))

