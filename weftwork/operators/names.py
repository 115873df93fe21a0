"""Fuzzy names by trigrams: similarity, search, and all similar pairs by a prefix filter, without meeting all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release

LEAST = 0.3


def trigrams(text: Column | str) -> Column:
    """array<string>: the distinct trigrams of the lower-cased words of letters and digits, each with two spaces before and
    one behind; empty without words, null for null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Trigrams (arrays) that both have over those that either has; 0 where there are none."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def similar_to(df: DataFrame, id_col: str, text_col: str, query: str, k: int, least: float = LEAST) -> DataFrame:
    """(id, similarity): the k names most similar to a query, of those at `least` or above; ties by id."""
    asked = trigrams(F.lit(query))
    scored = df.select(id_col, F.round(similarity(trigrams(text_col), asked), 9).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), id_col).limit(k)


def similar_names(df: DataFrame, text_col: str, least: float = LEAST) -> DataFrame:
    """(a, b, similarity): all pairs a < b of distinct names whose similarity is `least` or more (above 0).

    Two such sets share one of the first n - ceil(least * n) + 1 of their n trigrams, if both are sorted from the rarest
    trigram on; only names that share one of these meet, and only where their sizes allow it. Names without words and null
    names are similar to nothing. Frequent trigrams are at the end of the order, so a bucket holds names that share
    a rare one; a join whose bucket is hot all the same is split by Spark.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    names = materialize(df.select(F.col(text_col).alias("name")).where("name is not null").distinct().withColumn("t", trigrams("name")).where("size(t) > 0"), "names")
    often = names.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    each = names.select("name", F.size("t").alias("n"), F.explode("t").alias("g")).join(often, "g")
    ordered = each.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))  # a name's own trigrams
    first = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    sets = materialize(ordered.select("name", "n", F.transform("o", lambda x: x["g"]).alias("t"), F.transform(F.slice("o", 1, first), lambda x: x["g"]).alias("prefix")), "sets")
    keyed = sets.select("name", "n", F.explode("prefix").alias("g"))
    a, b = keyed.select(F.col("name").alias("a"), F.col("n").alias("m"), "g"), keyed.select(F.col("name").alias("b"), "n", "g")
    met = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.col("m") >= F.col("n") * F.lit(least) - 1e-9) & (F.col("n") >= F.col("m") * F.lit(least) - 1e-9))
    pairs = met.select("a", "b").distinct()
    x, y = sets.select(F.col("name").alias("a"), F.col("t").alias("ta")), sets.select(F.col("name").alias("b"), F.col("t").alias("tb"))
    checked = pairs.join(x, "a").join(y, "b").select("a", "b", F.round(similarity(F.col("ta"), F.col("tb")), 9).alias("similarity"))
    out = materialize(checked.where(F.col("similarity") >= least - 1e-9), "pairs")
    release(names, sets)
    return out
