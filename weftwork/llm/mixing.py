"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source stand in a shuffled order (a hash of their id). The virtual finish time of a document is the number
of its source's words up to and with it, over the source's weight; a second and further passes over a source continue the
count. All occurrences are sorted by finish time over range partitions and truncated where the total budget is reached.

Running totals are taken inside range partitions, whose sums (one row a partition) give the offsets: a source that holds a
third of the rows is spread over many partitions and no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh_names, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, PASSES, SEED = (3, 1, 2), 1.5, 2, 20240501


def running_total(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """`df` with, for each value column of `sums`, its sum over all rows up to each in the order of `order`.

    Also adds `weft_part` and `weft_place`, the row's range partition and number in it. The ranges are a table in the shared
    folder, which `release` of the result frees.
    """
    spread = materialize(df.repartitionByRange(*order).withColumn("weft_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("weft_part").orderBy(*order)
    totals = spread.groupBy("weft_part").agg(*[F.sum(v).alias(f"weft_{v}") for v in sums])
    # One row a range partition, so the window and the broadcast are bounded by the number of partitions.
    ahead = Window.orderBy("weft_part")
    before = totals.select("weft_part", *[(F.sum(f"weft_{v}").over(ahead) - F.col(f"weft_{v}")).alias(f"weft_{v}") for v in sums])
    placed = spread.withColumn("weft_place", F.row_number().over(inside))
    for v, out in sums.items():
        placed = placed.withColumn(out, F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.join(F.broadcast(before), "weft_part")
    for v, name in sums.items():
        out = out.withColumn(name, F.col(name) + F.col(f"weft_{v}")).drop(f"weft_{v}")
    out._scratch = spread._scratch
    return out


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> tuple[DataFrame, float]:
    """(source, source_size, start, weight, target) and the total budget.

    Sources are numbered by code point, null last, and take the weights in turn. Targets share `budget` times all sizes by
    weight; one above `passes` times its source's size stops there and the excess is shared again until none is above. The
    common level at which that ends follows from one pass over the sources in the order in which they stop.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = running_total(sums, [F.col("source").asc_nulls_last()], {"source_size": "upto"})
    ranked = running_rank(order).select("source", "source_size", (F.col("upto") - F.col("source_size")).alias("start"), "rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * passes).cast("double")), "sources")
    release(order)
    size, shares = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = (size or 0) * budget
    stops = running_total(sources.select("rank", "weight", "most", (F.col("most") / F.col("weight")).alias("stop")), [F.col("stop"), F.col("rank")], {"weight": "weights", "most": "mosts"})
    level = (F.lit(float(total)) - (F.col("mosts") - F.col("most"))) / (F.lit(float(shares or 0)) - (F.col("weights") - F.col("weight")))
    found = stops.withColumn("level", level).agg(F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).alias("first"), F.max("stop").alias("last")).first()
    release(stops)
    at = found["first"]["level"] if found["first"] is not None else found["last"] or 0.0
    out = sources.withColumn("target", F.least("most", F.col("weight") * at)).drop("most")
    out._scratch = sources._scratch
    return out, total


def running_rank(ranked: DataFrame) -> DataFrame:
    """The 0-based number of each row in the order of a running total."""
    counts = ranked.groupBy("weft_part").agg(F.count("*").alias("c"))
    before = counts.select("weft_part", (F.sum("c").over(Window.orderBy("weft_part")) - F.col("c")).alias("skip"))
    return ranked.join(F.broadcast(before), "weft_part").withColumn("rank", F.col("weft_place") - 1 + F.col("skip"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of `docs`.

    `size` counts the words of the whole text (null: 0), `taken` the words that the mix takes with repeats, `copies` how
    often the document occurs in it, at most `passes` times. A source ends within one document of its target. Documents
    without words take none, and occur as their place in the queue says. Null sources are one source, after all others;
    rows that repeat an id count as documents of their own, told apart by their size and otherwise alike, so that equal rows
    take the mix's places in any order; rows with a null id count as documents too. An empty table gives no rows. Other
    columns are ignored, whatever their names. Reruns agree.
    """
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0)).cast("long").alias("size")), "sizes")
    hashed = sized.withColumn("h", F.xxhash64("id", F.lit(seed)))
    sources, total = source_targets(hashed, weights, budget, passes)
    line = running_total(hashed, [F.col("source").asc_nulls_last(), F.col("h"), F.col("id"), F.col("size")], {"size": "upto"})
    # What holds for a source meets its rows by range and source, so that a source with many rows is spread as its ranges are.
    named = sources.withColumnRenamed("source", "of")
    ranges = line.select(F.col("weft_part").alias("part"), F.col("source").alias("its")).distinct().join(named, F.col("its").eqNullSafe(F.col("of"))).drop("of")
    queued = line.join(ranges.hint("merge"), (F.col("weft_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("its"))).withColumn("upto", F.col("upto") - F.col("start"))
    queued = materialize(queued.select("id", "h", "size", "upto", "source_size", "weight", "target"), "queue")
    release(sized, sources, line)

    def tag(turn: int | Column) -> Column:
        """What the mix is sorted by: finish time, then hash, id and pass."""
        finish = (F.col("upto") + F.col("source_size") * turn) / F.col("weight")
        return F.struct(finish.alias("finish"), F.col("h"), F.col("id"), F.lit(turn).cast("int").alias("turn") if isinstance(turn, int) else turn.cast("int").alias("turn"))

    turns = queued.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(passes)]))).select("size", tag(F.col("turn")).alias("tag"))
    fields = [F.col(f"tag.{c}") for c in ("finish", "h", "id", "turn")]
    mix = running_total(turns, fields, {"size": "upto"})
    last = mix.where(F.col("upto") <= F.lit(total)).agg(F.max("tag").alias("last")).first()["last"]
    release(mix)
    if last is None:
        copies = F.lit(0)
    else:
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["h"]).alias("h"), F.lit(last["id"]).cast(queued.schema["id"].dataType).alias("id"), F.lit(last["turn"]).alias("turn"))
        copies = sum((F.when(tag(i) <= end, 1).otherwise(0) for i in range(passes)), F.lit(0))
    out = queued.withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Of rows that repeat an id each occurs as often as the one that is taken most; rows with a null id count as one id.
    Columns may have any names and come back as they are; an empty table stays empty.
    """
    key, copies, copy = fresh_names(docs, "weft_key", "weft_copies", "weft_copy")
    verdict = mix_sources(docs, id_col, **options).groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    # The same join at every size: texts are moved once, in proportion.
    rows = docs.join(verdict.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies, copy)
