"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

Records are ordered by a hash of their text, so that equal texts are neighbours. A bounded sample of that key, drawn by size,
gives quantile boundaries, which cut the records into ranges; a range that turns out overfull (a text that a third of all
records share) is subdivided by splitters drawn, again by size, from the full order within it. Running totals inside the ranges,
and the ranges' own totals before them, give each record its place in the whole order, by bytes and by rows; the shard is
the sixteenth of all bytes in which the middle of the record lies.

No text is shuffled, only hashes and sizes, and equal records are counted before: they travel as one row of up to `COPIES`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh_names, materialize, new_path, release

SHARDS, SEED = 16, 20240607
#: Ranges at least and at most (each is a comparison in the plan), rows that a range should have, draws for each range, and most
#: copies that travel as one row.
RANGES, RANGES_MOST, RANGE_ROWS, DRAWS, COPIES = 128, 4096, 1 << 20, 32, 1024
#: A range is subdivided from so many times its share on.
OVERFULL = 2.0


def _draws(weight: Column, share: float, *key: str) -> Column:
    """How often a record is drawn if each `share` of weight is drawn once on average: fixed by its key, so reruns agree."""
    chance = F.pmod(F.xxhash64(*key, F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(weight / F.lit(share) + chance)


def _splitters(sample: DataFrame, group: list[str], key: str, cuts: Column) -> DataFrame:
    """(group..., key): of each group's sample (group..., key, draws) the keys at `cuts` - 1 quantiles. The sample has a bounded
    number of rows."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = sample.withColumn("upto", F.sum("draws").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("draws").over(w)).withColumn("cuts", cuts)
    cell = lambda c: F.floor(c * F.col("cuts") / F.col("all"))
    return ranked.where((cell(F.col("upto")) > cell(F.col("upto") - F.col("draws"))) & (F.col("upto") < F.col("all"))).select(*group, key).distinct()


def _bisect(found: list, past, at: int = 0) -> Column:
    """How many of the sorted values a row is past, as a balanced tree of comparisons."""
    if not found:
        return F.lit(at)
    mid = len(found) // 2
    return F.when(past(found[mid]), _bisect(found[mid + 1 :], past, at + mid + 1)).otherwise(_bisect(found[:mid], past, at))


def _ranged(records: DataFrame, total: int, rows: int) -> DataFrame:
    """`records` (key, sub, weight, ...) with `piece`, the number of their range in the order of key and sub."""
    ranges = min(RANGES_MOST, max(RANGES, -(-rows // RANGE_ROWS)))
    share = total / (ranges * DRAWS)
    sample = records.select("key", _draws(F.col("weight"), share, "key", "sub").alias("draws")).where("draws > 0").groupBy("key").agg(F.sum("draws").alias("draws"))
    # Some 2 * ranges * DRAWS keys at most are drawn, whatever the number of records; fewer than `ranges` are splitters.
    keys = sorted(r["key"] for r in _splitters(sample, [], "key", F.lit(ranges)).collect())
    cut = records.withColumn("range", _bisect(keys, lambda k: F.col("key") > F.lit(k)))
    full = cut.groupBy("range").agg(F.sum("weight").alias("held"))
    full = {r["range"]: int(r["held"] * ranges // total) + 1 for r in full.where(F.col("held") > F.lit(OVERFULL * total / ranges)).collect()}  # under `ranges` rows
    inner: dict[int, list] = {}
    if full:
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in full.items() for x in pair]), F.col("range"))
        drawn = cut.where(F.col("range").isin(list(full))).select("range", F.struct("key", "sub").alias("place"), _draws(F.col("weight"), share, "key", "sub", "sub").alias("draws"))
        drawn = drawn.where("draws > 0").groupBy("range", "place").agg(F.sum("draws").alias("draws"))
        for r in _splitters(drawn, ["range"], "place", parts).collect():  # under 2 * `ranges` rows
            inner.setdefault(r["range"], []).append((r["place"]["key"], r["place"]["sub"]))
    past = lambda p: (F.col("key") > F.lit(p[0])) | ((F.col("key") == F.lit(p[0])) & (F.col("sub") > F.lit(p[1])))
    part = F.lit(0)
    for number, places in inner.items():
        part = F.when(F.col("range") == number, _bisect(sorted(places), past)).otherwise(part)
    return cut.withColumn("piece", F.col("range").cast("long") * F.lit(1 << 32) + part.cast("long")).drop("range")


def _placed(ranged: DataFrame) -> DataFrame:
    """`ranged` with the bytes (`ahead`) and records (`before`) before each row in the whole order."""
    inside = Window.partitionBy("piece").orderBy("key", "sub", "id", "size", "crc", "block").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("piece").agg(F.sum("weight").alias("w"), F.sum("copies").alias("c"))
    # One row a range: the window and the broadcast are bounded by the number of ranges.
    ahead = Window.partitionBy(F.lit(0)).orderBy("piece")
    offsets = totals.select("piece", (F.sum("w").over(ahead) - F.col("w")).alias("w"), (F.sum("c").over(ahead) - F.col("c")).alias("c"))
    within = ranged.withColumn("ahead", F.sum("weight").over(inside) - F.col("weight")).withColumn("before", F.sum("copies").over(inside) - F.col("copies"))
    return within.join(F.broadcast(offsets), "piece").withColumn("ahead", F.col("ahead") + F.col("w")).withColumn("before", F.col("before") + F.col("c")).drop("w", "c", "piece")


def shard_records(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, size, crc, key, shard, slot) for each record (id, size, crc, key); `key` is a long, `size` above 0.

    Shards follow the order of the keys, and each ends within half a record of its share of all bytes. Slots number the
    records of a shard without gaps. Records that are alike in all four columns are counted first and take the places of
    their group; a null id is an id of its own. Without records there are no rows.
    """
    counted = records.groupBy("id", "size", "crc", "key").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    blocks = blocks.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES)).withColumn("sub", F.xxhash64("id", "size", "crc", "block"))
    blocks = materialize(blocks.select("id", "size", "crc", "key", "sub", "block", "copies", (F.col("copies") * F.col("size")).alias("weight")), "records")
    total, rows = blocks.agg(F.sum("weight"), F.sum("copies")).first()
    if not rows:
        return blocks.select("id", "size", "crc", "key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = materialize(_placed(_ranged(blocks, total, rows)), "placed")
    release(blocks)
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    ahead, before = F.col("ahead") + F.col("copy") * F.col("size"), F.col("before") + F.col("copy")
    # The shard of the record's middle, in halves of a byte; all are below 2 * total, so no shard is past the last.
    shard = F.floor(((2 * ahead + F.col("size")).cast("decimal(38,0)") * shards) / F.lit(2 * total).cast("decimal(38,0)")).cast("int")
    each = each.select("id", "size", "crc", "key", shard.alias("shard"), before.alias("before"))
    first = each.groupBy("shard").agg(F.min("before").alias("first"))  # one row a shard
    return each.join(F.broadcast(first), "shard").select("id", "size", "crc", "key", "shard", (F.col("before") - F.col("first")).alias("slot"))


def _record(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key")]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`, by the law `bytes`: sizes of the shards
    are near equal, within about one record.

    `size` is the text's UTF-8 bytes (null: none) plus 1; `grown_shard` is null, as the law isn't `key`. A text above a
    shard's share can't be divided and fills one. Null and empty texts have size 1; null and repeated ids count as records of
    their own; other columns are ignored, whatever their names; an empty table has no rows. Reruns agree but for which of
    several records that are alike takes which of their slots.
    """
    rows = shard_records(docs.select(*_record(id_col, text_col)), shards)
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> str:
    """Write all rows of `docs` with `shard` and `slot` below `path` (a new folder of the shared one if not given), a folder
    `shard=N` for each shard, and give the path. Names of added columns get underscores where `docs` has them."""
    path = path or new_path(docs.sparkSession, "shards")
    a, b, shard, slot = fresh_names(docs, "weft_a", "weft_b", "shard", "slot")
    every = [F.col(f"`{c}`") for c in docs.columns]
    # Rows that are alike in all columns are interchangeable: one of them is joined to all their places.
    once = docs.withColumns({a: F.xxhash64(*every), b: F.xxhash64(*reversed(every), F.lit(SEED))})
    size = (F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) + 1).cast("long")
    places = shard_records(once.select(F.col(a).alias("id"), size.alias("size"), F.col(b).alias("crc"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key")), shards)
    placed = places.select(F.col("id").alias(a), F.col("crc").alias(b), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = once.dropDuplicates([a, b]).join(placed, [a, b]).drop(a, b)
    out.repartitionByRange(F.col(shard), F.col(slot)).write.partitionBy(shard).parquet(path)
    return path
