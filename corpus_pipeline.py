"""A training-data pipeline: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm.bpe import round_trip
from weftwork.llm.mixing import mixed_documents
from weftwork.llm.neardup import drop_near_duplicates
from weftwork.llm.pii import redact_personal_data
from weftwork.llm.quality import keep_good
from weftwork.llm.storage import materialize, release
from weftwork.session import table

#: Least similarity of near-duplicates; the 85 of `op1_near_dedup` is that query's alone.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the classifier keep.

    Null, empty and blank texts have under 50 words and go; rows that repeat an id or a text are judged each by its own text;
    rows with a null id are judged alike. All columns stay; an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of 0.8 or more: the one with the smallest id.

    Texts without words link with nothing and stay, as do rows with a null id; of rows that repeat an id with one text one
    stays. All columns stay; an empty table stays empty.
    """
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; `n_chars` follows the new text.

    Null texts stay null; all rows, repeated ones and those with a null id too, and all other columns stay.
    """
    return redact_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeat is a row of its own.

    Texts without words come in as their place in the queue says; null sources are one source; rows that repeat an id occur
    as often as the one that is taken most, and a null id counts as one id. All columns stay; an empty table stays empty.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes that they decode to, one row for each row.

    Null and empty texts have no tokens. An empty table gives no rows.
    """
    return round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("byte-level BPE", encoding),
]

#: SQL can't express the classifier, the hash order of the mix or the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
