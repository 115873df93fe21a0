"""Vectors of texts without a model: words and letter trigrams hashed to signed dimensions, weighted by the corpus, unit length.

Everything is an expression; a text's vector depends on its own features and on the corpus' document frequencies, which are a
table that is kept beside the vectors and by which queries are weighted too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .names import trigrams
from .text_index import words

DIMENSIONS = 256


class TextVectors(NamedTuple):
    """Where the vectors and the corpus figures lie, the id column, dimensions and number of texts."""

    path: str
    id_col: str
    dimensions: int
    texts: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(id, vector) of all texts; a text without features has a null vector."""
        return spark.read.parquet(f"{self.path}/vectors")


def features(text: Column | str) -> Column:
    """array<string>: the words of a text, with repeats, and its distinct letter trigrams, marked to keep both apart."""
    return F.concat(F.transform(words(text), lambda w: F.concat(F.lit("w:"), w)), F.transform(F.coalesce(trigrams(text), F.array().cast("array<string>")), lambda g: F.concat(F.lit("g:"), g)))


def _hash(feature: Column) -> Column:
    """A 32-bit number of a feature, as long."""
    return F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("long")


def _counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, feature, tf) of each text."""
    return df.select(F.col(id_col).alias("id"), F.explode(features(text_col)).alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("tf"))


def _vectors(counted: DataFrame, frequencies: DataFrame, texts: int, dimensions: int) -> DataFrame:
    """(id, vector): (1 + ln tf) * ln(1 + texts / df) of each feature, with its sign, summed by dimension and scaled to unit
    length. Features that the corpus doesn't have count as in one text."""
    weight = (1 + F.log("tf")) * F.log(1 + F.lit(float(texts)) / F.coalesce("df", F.lit(1)))
    h = _hash(F.col("feature"))
    parts = counted.join(frequencies, "feature", "left").select("id", (h % dimensions).cast("int").alias("d"), (weight * F.when((h / dimensions).cast("long") % 2 == 0, 1.0).otherwise(-1.0)).alias("x"))
    cells = parts.groupBy("id", "d").agg(F.sum("x").alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))  # one entry a dimension
    size = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x * x))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    return cells.select("id", dense.alias("v"), size.alias("size")).select("id", F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).alias("vector"))


def build_text_vectors(df: DataFrame, id_col: str, text_col: str, path: str, dimensions: int = DIMENSIONS) -> TextVectors:
    """Write the vectors of all texts and the corpus figures below `path`, a new folder. Rows that repeat an id count as one
    text; empty and null texts count as texts and have a null vector."""
    counted = materialize(_counted(df, id_col, text_col), "features")
    ids = df.select(F.col(id_col).alias("id")).distinct()
    texts = ids.count()
    df_ = counted.groupBy("feature").agg(F.count("*").alias("df"))
    df_.write.parquet(f"{path}/frequencies")
    frequencies = df.sparkSession.read.parquet(f"{path}/frequencies")
    made = _vectors(counted, frequencies, texts, dimensions)
    ids.join(made, "id", "left").write.parquet(f"{path}/vectors")
    release(counted)
    return TextVectors(path, id_col, dimensions, texts)


def query_vector(spark: SparkSession, index: TextVectors, query: str) -> list[float]:
    """The vector of a query by the corpus' figures; empty if it has no features."""
    row = spark.createDataFrame([(0, query)], "id int, text string")
    asked = _counted(row, "id", "text")
    wanted = [r["feature"] for r in asked.select("feature").collect()]  # of one query
    frequencies = spark.read.parquet(f"{index.path}/frequencies").where(F.col("feature").isin(wanted))
    found = _vectors(asked, frequencies, index.texts, index.dimensions).first()
    return list(found["vector"]) if found is not None and found["vector"] is not None else []
