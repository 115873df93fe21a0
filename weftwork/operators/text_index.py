"""A full-text index: postings in folders by a hash of their term, with the corpus figures beside them.

A search reads only the folders of its terms, and in them only the files whose range of terms has them; texts are read once,
when the index is built. Terms are the lower-cased runs of letters and digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import DIGITS, top_k

BUCKETS = 64
#: Terms that a task hands to Spark at once.
BLOCKS = 4096
SPLIT = r"[^\p{L}\p{N}]+"


class TextIndex(NamedTuple):
    """Where the index lies, its number of buckets, the corpus' texts and mean number of words, and the type of ids."""

    path: str
    id_col: str
    buckets: int
    texts: int
    mean: float
    id_type: str

    def postings(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        """(id, term, tf, n, places) of some terms: how often each text has the term, its words, and the term's places."""
        rows = spark.read.schema(f"term string, id {self.id_type}, tf int, n int, places array<int>, bucket int").parquet(f"{self.path}/postings")
        if not terms:
            return rows.drop("bucket").limit(0)
        # Constants, which Catalyst folds into a filter on folders.
        folders = reduce(or_, [F.col("bucket") == _bucket(F.lit(t), self.buckets) for t in terms])
        return rows.where(folders & F.col("term").isin(list(terms))).drop("bucket")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def words(text: Column | str) -> Column:
    """The terms of a text in order; none of a null text."""
    return F.coalesce(F.filter(F.split(F.lower(text), SPLIT), lambda x: x != ""), F.array().cast("array<string>"))


def terms_of(query: str) -> list[str]:
    """The terms of a query, as those of a text."""
    return "".join(c if c.isalnum() else " " for c in query.lower()).split()


def _lists(begins: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a batch of texts: the texts that have it, by id, their words, and its places in all of them
    one after another, with the end of each text's part. Flat lists take less of a shuffle than lists of lists."""
    for batch in batches:
        ids, said = batch.column(0), batch.column(1)
        sizes = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int32)
        words = pc.list_flatten(said).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        if not len(codes):
            continue
        order = np.argsort(codes, kind="stable")  # within a term by text and place, as they come
        codes, text = codes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        place = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
        begins = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])]))
        own, held = codes[begins], text[begins]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        lists = [_lists(heads, ids.take(pa.array(held))), _lists(heads, pa.array(sizes[held])), _lists(heads, pa.array((np.append(begins[1:], len(order)) - np.repeat(begins[heads], np.diff(np.append(heads, len(own))))).astype(np.int32)))]
        flat = _lists(begins[heads], pa.array(place))
        out = pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(own[heads])), *lists, flat], names=["term", "ids", "ns", "ends", "flat"])
        for at in range(0, out.num_rows, BLOCKS):
            yield out.slice(at, BLOCKS)


def build_text_index(df: DataFrame, id_col: str, text_col: str, path: str, buckets: int = BUCKETS) -> TextIndex:
    """Index all texts of `df` below `path`, a new folder. Ids have to be unique and not null, else it is a ValueError.

    A text's postings are made where it is read, so that each is shuffled once, in blocks that hold a term's texts of one
    batch; no text is. Blocks are range-partitioned by bucket, term and first id, so that a term that all texts have is
    spread over many files, and postings sorted within them. Empty and null texts count in the corpus figures.
    """
    spark = df.sparkSession
    texts, known = df.agg(F.count("*"), F.count_distinct(id_col)).first()
    if texts != known:
        raise ValueError(f"{texts - known} texts have no id of their own")
    of = df.schema[id_col].dataType.simpleString()
    blocks = df.select(F.col(id_col).alias("id"), words(text_col).alias("w")).mapInArrow(_blocks, f"term string, ids array<{of}>, ns array<int>, ends array<int>, flat array<int>")
    placed = blocks.withColumns({"bucket": _bucket(F.col("term"), buckets), "first": F.col("ids")[0]}).repartitionByRange("bucket", "term", "first")
    each = placed.select("bucket", "term", "ns", "ends", "flat", F.posexplode("ids").alias("at", "id"))
    begin = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("ends")[F.col("at") - 1])
    tf = F.col("ends")[F.col("at")] - begin
    rows = each.select("bucket", "term", "id", tf.alias("tf"), F.col("ns")[F.col("at")].alias("n"), F.slice("flat", begin + 1, tf).alias("places"))
    rows = rows.sortWithinPartitions("bucket", "term", "id")
    rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    said = spark.read.schema(rows.schema).parquet(f"{path}/postings").agg(F.sum("tf")).first()[0]
    spark.createDataFrame([(id_col, buckets, texts, (said or 0) / max(1, texts), of)], "id_col string, buckets int, texts long, mean double, id_type string").coalesce(1).write.parquet(f"{path}/corpus")
    return open_text_index(spark, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    r = spark.read.parquet(f"{path}/corpus").first()
    return TextIndex(path, r["id_col"], r["buckets"], r["texts"], r["mean"], r["id_type"])


def matching(spark: SparkSession, index: TextIndex, query: str, every: bool = True) -> DataFrame:
    """(id): the texts with all terms of a query, or with any of them. A query without terms has none."""
    terms = sorted(set(terms_of(query)))
    found = index.postings(spark, terms).groupBy("id").agg(F.count("*").alias("terms"))
    return found.where(F.col("terms") >= (len(terms) if every else 1)).select(F.col("id").alias(index.id_col))


def phrase(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """(id, place): each place (from 0, in words) at which a text has the terms of the query one after another.

    Each posting votes for the place where the phrase would begin; a place with a vote from every term of the phrase is a
    hit. Terms that the phrase repeats vote for each of their places in it.
    """
    terms = terms_of(query)
    at = {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
    offsets = F.element_at(F.create_map(*[F.lit(x) for t, places in at.items() for x in (t, places)]), F.col("term")) if at else F.array().cast("array<int>")
    votes = index.postings(spark, sorted(at)).select("id", F.explode("places").alias("p"), offsets.alias("offsets")).select("id", "p", F.explode("offsets").alias("o"))
    found = votes.where("p >= o").groupBy("id", (F.col("p") - F.col("o")).alias("place")).agg(F.count("*").alias("votes"))
    return found.where(F.col("votes") == len(terms)).select(F.col("id").alias(index.id_col), "place")


def ranked_texts(spark: SparkSession, index: TextIndex, query: str | Sequence[str], k: int, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """(id, score): the k texts with the highest Okapi BM25 score, as `search.bm25` has it; with `every`, of those with all
    terms. Places aren't read."""
    terms = sorted(set(terms_of(query) if isinstance(query, str) else (t.lower() for t in query)))
    rows = index.postings(spark, terms).select("id", "term", "tf", "n")
    held = {r["term"]: r["texts"] for r in rows.groupBy("term").agg(F.count("*").alias("texts")).collect()}  # a row for each term of the query
    if not held:
        return rows.select(F.col("id").alias(index.id_col), F.lit(0.0).alias("score")).limit(0)
    idf = F.element_at(F.create_map(*[F.lit(x) for t, d in held.items() for x in (t, math.log1p((index.texts - d + 0.5) / (d + 0.5)))]), F.col("term"))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(index.mean or 1.0)))
    scored = rows.groupBy("id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.count("*").alias("terms"))
    found = scored.where(F.col("terms") >= len(terms) if every else F.col("score") > 0).select(F.col("id").alias(index.id_col), "score")
    return top_k(found, "score", k, index.id_col)
