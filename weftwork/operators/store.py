"""Tables that change: upserts, deletes, first- and last-wins, registries, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh_names


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """`base` with rows replaced by those of `new` that have their key; of several new ones the last wins: the greatest by
    `order`, then by the remaining columns. Only keys are compared: base rows without a new one stay, by an anti join."""
    rest = [*order, *[c for c in new.columns if c not in order and c not in keys]]
    (packed,) = fresh_names(new, "weft_last")
    if rest:
        last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias(packed)).select(*keys, *[F.col(packed)[c].alias(c) for c in rest]).select(*new.columns)
    else:
        last = new.distinct()
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(last.select(*base.columns))


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number deleted); a null condition deletes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"))


def is_fresh(index_time: Column, latest_source: Column) -> Column:
    """An index is fresh if it exists and no source is newer; without sources it is fresh."""
    return index_time.isNotNull() & (latest_source.isNull() | (index_time >= latest_source))


def registry_key(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit(":"), version)
