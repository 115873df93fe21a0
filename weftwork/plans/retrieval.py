"""Queries over kept indexes of the driver tables: vectors by centroids, postings, adjacency. An index is built once in a
session and again when a file of its table changes; each query reads only the folders that it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_index as gi
from ..operators import text_index as ti
from ..operators import vector_index as vi
from ..scratch import kept
from ..session import table
from .registry import _COS, _EDGES, BM25_SQL, _vector, _walk, dependency_edges, query

#: Queries on which the number of lists is chosen that a search reads where it doesn't have to be exact.
TUNED_ON = 64


def vector_index(spark: SparkSession, sf_dir: str) -> vi.VectorIndex:
    path = kept(spark, "vector-index", [f"{sf_dir}/embeddings.parquet"], lambda p: vi.build_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", p))
    return vi.open_index(spark, path)


def text_index(spark: SparkSession, sf_dir: str) -> ti.TextIndex:
    path = kept(spark, "text-index", [f"{sf_dir}/documents.parquet"], lambda p: ti.build_text_index(table(spark, sf_dir, "documents"), "doc_id", "text", p))
    return ti.open_text_index(spark, path)


def adjacency(spark: SparkSession, sf_dir: str) -> gi.Adjacency:
    names = ("region", "nation", "customer", "supplier", "orders", "lineitem")
    path = kept(spark, "adjacency", [f"{sf_dir}/{n}.parquet" for n in names], lambda p: gi.build_adjacency(dependency_edges(spark, sf_dir), p))
    return gi.Adjacency(path, gi.BUCKETS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")


@query(f"SELECT vec_id, label, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact search that begins with the nearest lists."""
    index = vector_index(spark, sf_dir)
    return vi.index_search(spark, index, _vector(spark, sf_dir, 0), 10, exact=True).select("vec_id", "label", "score")


_NEAREST = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS asked FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], asked), 9) AS score FROM q, embeddings WHERE query <> vec_id),
n AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10)"""


@query(f"WITH {_NEAREST} SELECT * FROM n")
def vector_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id 100 divides against all rows, through all lists: the exact way."""
    return vi.index_neighbours(_asked(spark, sf_dir), vector_index(spark, sf_dir), 10, None).drop("list_rank")


@query(f"WITH {_NEAREST} SELECT count(*) AS wanted, true AS reached FROM n")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether as many lists as other queries need for 0.97 of their neighbours give 0.9 of those of these."""
    index, asked = vector_index(spark, sf_dir), _asked(spark, sf_dir)
    others = table(spark, sf_dir, "embeddings").where("vec_id % 100 <> 0").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(TUNED_ON)
    probes = vi.probes_for(others, index, 10, 0.97)
    got = vi.recall(vi.index_neighbours(asked, index, 10, probes), vi.index_neighbours(asked, index, 10, None))
    return got.select("wanted", (F.col("recall") >= 0.9).alias("reached"))


_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"
def _phrase_sql(phrase: str) -> str:
    first, *rest = phrase.split()
    tests = " AND ".join([f"w[p] = '{first}'", *[f"w[p + {i}] = '{t}'" for i, t in enumerate(rest, 1)]])
    return f"WITH {_WORDS}, p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) SELECT doc_id, (p - 1)::INT AS place FROM p WHERE {tests}"


@query(_phrase_sql("of the the"))
def text_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.phrase(spark, text_index(spark, sf_dir), "Of the, the")


@query(BM25_SQL)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ti.ranked_texts(spark, text_index(spark, sf_dir), ("worthless", "the"), 10)
    return got.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT doc_id FROM w WHERE list_contains(w, 'worthless') AND list_contains(w, 'the')")
def text_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.matching(spark, text_index(spark, sf_dir), "the worthless")


@query(f"WITH {_WORDS} SELECT doc_id FROM w WHERE list_contains(w, 'worthless') OR list_contains(w, 'token')")
def text_index_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.matching(spark, text_index(spark, sf_dir), "token worthless", every=False)


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE dst = 'nation.3'")
def graph_index_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gi.index_neighbours(spark, adjacency(spark, sf_dir), "nation.3", "in")


@query(_walk("order.1", 5, "src", "dst") + " SELECT * FROM closed")
def dep_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gi.index_closure(spark, adjacency(spark, sf_dir), "order.1", 5, "out")


@query(_walk("region.1", 3, "dst", "src") + " SELECT * FROM closed")
def dep_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gi.index_closure(spark, adjacency(spark, sf_dir), "region.1", 3, "in")


@query(_walk("part.7", 10, "dst", "src") + " SELECT count(*) AS impact FROM closed")
def impact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gi.index_closure(spark, adjacency(spark, sf_dir), "part.7", 10, "in").agg(F.count("*").alias("impact"))


@query(_walk("order.1", 2, "src", "dst") + " SELECT src, dst FROM edges WHERE src = 'order.1' OR src IN (SELECT node FROM closed WHERE depth < 2)")
def dep_closure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gi.index_closure_edges(spark, adjacency(spark, sf_dir), "order.1", 2, "out")
