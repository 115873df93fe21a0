"""Filtered, vector, text and hybrid search as lazy DataFrame plans.

Ties are broken by an id, so that results are deterministic. Query vectors and terms are literals, never a join side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

RRF_K = 60
DIGITS = 9


def matches(filters: dict[str, object], null_matches_null: bool = True) -> Column:
    """AND of equality tests. A None value matches nulls, or is skipped where `null_matches_null` is false."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is None and not null_matches_null:
            continue
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a literal vector in double precision, over the shorter length; 0 where a norm is 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    size = norm(v) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def term_overlap(text: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that are substrings of the lower-cased text."""
    low = F.lower(text)
    hits = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    return hits / F.lit(max(1, len(terms)))


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k rows with the highest scores: one TakeOrderedAndProject."""
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def scored_vectors(df: DataFrame, vector_col: str, query: Sequence[float]) -> DataFrame:
    """`df` with the cosine `score`; rows without a vector are skipped."""
    return df.where(F.col(vector_col).isNotNull()).withColumn("score", F.round(cosine(F.col(vector_col), query), DIGITS))


def scored_texts(df: DataFrame, text_col: str, terms: Sequence[str]) -> DataFrame:
    """`df` with the term overlap as `score`; rows without a hit are dropped."""
    return df.withColumn("score", F.round(term_overlap(F.col(text_col), terms), DIGITS)).where("score > 0")


def vector_search(df: DataFrame, vector_col: str, query: Sequence[float], k: int, id_col: str) -> DataFrame:
    """Exact search over all rows with a vector."""
    return top_k(scored_vectors(df, vector_col, query), "score", k, id_col)


def text_search(df: DataFrame, text_col: str, terms: Sequence[str], k: int, id_col: str) -> DataFrame:
    """The k rows with the largest share of the terms."""
    return top_k(scored_texts(df, text_col, terms), "score", k, id_col)


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """1-based ranks of an already limited list; the window sees at most k rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(tie))))


def rrf(lists: Sequence[DataFrame], id_col: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (rrf_k + rank) over the lists; ties keep the order of the first list, then of later ones."""
    parts = [x.select(id_col, "rank", F.lit(i).alias("src")) for i, x in enumerate(lists)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    fused = all_.groupBy(id_col).agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("s"), F.min(F.struct("src", "rank")).alias("first"))
    fused = fused.withColumn("rrf_score", F.round("s", DIGITS))
    return fused.orderBy(F.col("rrf_score").desc(), "first").limit(k).select(id_col, "rrf_score")


def hybrid(texts: DataFrame, vectors: DataFrame | None, id_col: str, k: int = 10) -> DataFrame:
    """Text and vector candidates (2k each) fused by rank, from two tables (id, score); without vectors, text only."""
    lists = [ranked(top_k(t.select(id_col, "score"), "score", 2 * k, id_col), "score", id_col) for t in (texts, vectors) if t is not None]
    return rrf(lists, id_col, k)


def hybrid_search(df: DataFrame, id_col: str, text_col: str, vector_col: str, terms: Sequence[str], query: Sequence[float], k: int = 10) -> DataFrame:
    """`hybrid` over one table with texts and vectors; without a query vector, text only."""
    vectors = scored_vectors(df, vector_col, query) if query else None
    return hybrid(scored_texts(df, text_col, terms), vectors, id_col, k)


def semantic_search(chunks: DataFrame, terms: Sequence[str], query: Sequence[float], filters: dict[str, object], k: int = 5, id_col: str = "chunk_id", text_col: str = "code_text", vector_col: str = "embedding", most: int = 20) -> DataFrame:
    """(id, rank, score, snippet, and the table's other columns): the hybrid search over the chunks of a configuration and
    version, whose filters the caller's may override; k is 1 to `most`. Only the k hits are read with their texts."""
    if not 1 <= k <= most:
        raise ValueError(f"k has to be 1 to {most}")
    layer = chunks.where(matches(filters, null_matches_null=False))
    hits = hybrid_search(layer, id_col, text_col, vector_col, terms, query, k)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rrf_score").desc(), id_col)))  # k rows
    rest = [c for c in chunks.columns if c not in (id_col, text_col, vector_col)]
    both = layer.join(F.broadcast(hits), id_col)  # k rows
    return both.select(id_col, "rank", F.col("rrf_score").alias("score"), F.substring(F.coalesce(text_col, F.lit("")), 1, 200).alias("snippet"), *rest)


def layered_search(chunks: DataFrame, terms: Sequence[str], query: Sequence[float], layers: Sequence[dict[str, object]], ref_col: str, k: int = 5, id_col: str = "chunk_id", text_col: str = "code_text", vector_col: str = "embedding", most: int = 20) -> DataFrame:
    """The hits of `semantic_search` in each layer, a configuration first and then libraries, as (layer, ...), at most k: of
    hits with one ref the first counts, by layer, then rank; a null ref is like no other. A layer's hits come before those of
    the next."""
    found = None
    for i, layer in enumerate(layers):
        hits = semantic_search(chunks, terms, query, layer, k, id_col, text_col, vector_col, most).select(F.lit(i).alias("layer"), "*")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("there has to be a layer")
    # At most k rows a layer from here on.
    own = Window.partitionBy(F.coalesce(F.col(ref_col).cast("string"), F.concat(F.lit("\0"), F.col(id_col).cast("string")))).orderBy("layer", "rank")
    return found.withColumn("weft_n", F.row_number().over(own)).where("weft_n = 1").drop("weft_n").orderBy("layer", "rank").limit(k)


def similar(df: DataFrame, id_col: str, vector_col: str, seed, k: int, exclude: Column | None = None) -> DataFrame:
    """The k rows most similar to the row `seed`, which is left out before the limit; an unknown seed has none."""
    row = df.where(F.col(id_col) == seed).select(vector_col).first()
    if row is None or row[0] is None:
        return df.withColumn("score", F.lit(None).cast("double")).limit(0)
    rest = df.where(F.col(id_col) != seed)
    return vector_search(rest if exclude is None else rest.where(~exclude), vector_col, row[0], k, id_col)


def field_score(title: Column, ident: Column, tags: Column, fields: Sequence[Column], source: Column, kind: Column, query: str) -> Column:
    """Weighted substring score of a rule: title 1.0, id 0.8, each tag 0.5, each further field 0.3, source 0.7, its kind 0.4."""
    q = F.lit(query.lower())

    def has(c: Column) -> Column:
        return F.coalesce(F.contains(F.lower(c), q), F.lit(False))

    def points(c: Column, w: float) -> Column:
        return F.when(has(c), F.lit(w)).otherwise(F.lit(0.0))

    total = points(title, 1.0) + points(ident, 0.8) + points(source, 0.7) + points(kind, 0.4)
    total = total + 0.5 * F.size(F.filter(tags, has))
    for f in fields:
        total = total + points(f, 0.3)
    return F.round(total, 6)


def bm25(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """Ranking by Okapi BM25 over lower-cased words (an extension); with `every`, only texts with all terms. The texts are
    read once: their word and term counts are written, and corpus figures and scores come from that table."""
    low = [t.lower() for t in terms]
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    counted = df.select(id_col, F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(low)).alias("hits")))[0].alias("c"))

    def count(term: str) -> Column:
        return F.size(F.filter("c.hits", lambda x: x == term))

    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(low)]
    counted = materialize(counted.select(id_col, F.coalesce("c.n", F.lit(0)).alias("n"), *tf), "counts")
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score, all_ = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        idf = F.lit(float(math.log1p((stats["docs"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))))
        t = F.greatest(F.col(f"tf{i}"), F.lit(0))
        all_ = all_ & (t > 0)
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("n") / F.lit(stats["mean"] or 1.0)))
    found = counted.select(id_col, F.round(score, DIGITS).alias("score"), all_.alias("all")).where(F.col("score") > 0 if not every else F.col("all"))
    return top_k(found.drop("all"), "score", k, id_col)
