"""Vector code compression: integer product codebooks, trained in rounds of exact sums.

Components become integers, so that every distance and every sum is exact and no result depends on the partitioning. A round
sends the codebooks (a fixed number of entries) to the tasks, which find each part's nearest entry by the expansion
|x - c|^2 = |x|^2 - 2 x.c + |c|^2 with integer matrix products, and emit one row for each entry that they used: its count and
its sums. These are merged by a grouped shuffle and give the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release
from .vectors import integers, kept_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances are held at a time.
BLOCK = 2048


class Codebooks(NamedTuple):
    """`entries` is an int64 array by part, entry and position within the part."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _limit(width: int) -> int:
    """Components below it keep the distances of a part of this width, and their sum over the parts, within 64 bits."""
    return int((2**61 / (3 * max(1, width))) ** 0.5)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `x` the first of the nearest entries and the squared distance to it."""
    half = (entries * entries).sum(1) - 2 * (x @ entries.T)
    best = half.argmin(1)
    return best, half[np.arange(len(x)), best] + (x * x).sum(1)


def _blocks(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray]]:
    """The batch's vectors (its last column) as integers by row, part and position, with the number of the first row."""
    parts, _, width = books.entries.shape
    x = integers(batch.column(batch.num_columns - 1), parts * width, books.scale, limit=_limit(parts * width))
    for i in range(0, len(x), BLOCK):
        yield i, x[i : i + BLOCK].reshape(-1, parts, width)


def _sums(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, size, width = books.entries.shape
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, books):
                for p in range(parts):
                    best, _ = nearest(x[:, p], books.entries[p])
                    np.add.at(total[p], best, x[:, p])
                    count[p] += np.bincount(best, minlength=size)
        part, entry = count.nonzero()
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "count", "sums"])

    return run


def _codes(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts = len(books.entries)
        for batch in batches:
            codes = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for i, x in _blocks(batch, books):
                for p in range(parts):
                    best, far = nearest(x[:, p], books.entries[p])
                    codes[i : i + len(x), p] = best
                    error[i : i + len(x)] += far
            digits = codes.tobytes().hex()
            names = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def train(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the rows (id, ..., vector) of one dimension.

    They begin as the parts of the first `entries` rows by id, then vector (nulls last; rows that repeat an id count each).
    Each round assigns every part to its nearest entry, the first of equally near ones, and moves each used entry to the
    floor of its parts' mean. Only the codebooks, `parts` * `entries` rows, reach the driver.
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
    start = integers(pa.array([r[0] for r in first.collect()], pa.list_(pa.float64())), width, scale, limit=_limit(width))  # at most `entries` rows
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)), scale)
    each = width // parts
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)
        partial = kept.select("vector").mapInArrow(_sums(shared), "part int, entry int, count long, sums array<long>")
        merged = partial.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(each)]).alias("sums"))
        moved = books.entries.copy()
        for r in merged.collect():  # at most `parts` * `entries` rows
            moved[r["part"], r["entry"]] = [s // r["count"] for s in r["sums"]]
        shared.unpersist()
        books = Codebooks(moved, scale)
    return books


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each row with a finite vector.

    `code` has two hex digits for each part, `error` the squared distances to the entries summed over the parts,
    `label_error` the errors summed over the rows with the same label (null labels together). Rows whose vector is null or has
    null or non-finite components are dropped. Vectors of another length than the most frequent one stay, with a null code
    and error, and train nothing. With fewer rows than `entries` the codebooks are that small; without rows there is no
    result. Null and repeated ids count as rows of their own; other columns are ignored, whatever their names. A dimension
    that `parts` doesn't divide is a ValueError; components past some 2^28 / `scale` fail in place of wrong numbers.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    kept, width = kept_vectors(df, {id_col: "id", label_col: "label"}, vector_col)
    if width % parts:
        raise ValueError(f"{width} dimensions can't be cut into {parts} equal parts")
    same = kept.where(F.size("vector") == width)
    books = train(same, width, parts, entries, rounds, scale) if width else Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    spec = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    nothing = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if width:
        shared = df.sparkSession.sparkContext.broadcast(books)
        coded = materialize(same.mapInArrow(_codes(shared), spec).unionByName(nothing.where(F.size(kept["vector"]) != width)), "codes")
    else:
        coded = materialize(nothing, "codes")
    release(kept)
    # A small table by Spark's own measure of its files is sent to the tasks; else the join splits hot labels.
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "totals")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
