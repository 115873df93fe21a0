"""Whitening of vectors by an exact scatter matrix.

Components become integers. A first pass has their exact sums; a second one multiplies the rows, less the floor of their
mean, modulo several primes: products of residues below 2^20 over blocks of 2^13 rows stay below 2^53, so that plain double
matrix products of them are exact. Reduced sums of each partition are merged by a grouped shuffle, the Chinese remainder
theorem gives the integer scatter, and what the floor left of the mean is taken off in integers. Only the covariance is
rounded, once, before its eigenvectors are taken in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integers, kept_vectors

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows of a product, bits of a prime, and columns of one row of partial sums.
ROWS, BITS, COLUMNS = 1 << 13, 20, 64
#: Integers beyond it would leave 64 bits when they are multiplied by a row count or added up.
LIMIT = 1 << 40


class Whitening(NamedTuple):
    """What was fitted: rows, sums of each dimension, its least and greatest integer, covariance, eigenvalues from the
    greatest on, and the matrix that takes a centred vector to its components (nan for a component without variance)."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    covariance: np.ndarray
    values: np.ndarray
    project: np.ndarray

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)


def primes(above: int) -> list[int]:
    """The greatest primes below 2^BITS, two or more, whose product is over `above`."""
    found: list[int] = []
    p = (1 << BITS) - 1
    while len(found) < 2 or prod(found) <= above:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
        p -= 2
    return found


def chinese(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest to 0 with these residues."""
    whole, x = prod(moduli), 0
    for r, p in zip(residues, moduli, strict=True):
        x += r * (whole // p) * pow(whole // p, -1, p)
    x %= whole
    return x - whole if 2 * x > whole else x


def _moments(width: int, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, object)
        low, high = np.full(width, LIMIT), np.full(width, -LIMIT)
        for batch in batches:
            x = integers(batch.column(0), width, scale, shift, LIMIT)
            if len(x):
                n, sums, low, high = n + len(x), sums + x.sum(0).astype(object), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(sums.tolist(), pa.int64()), pa.array(low), pa.array(high)], names=["dim", "n", "sum", "low", "high"])

    return run


def _products(floor: np.ndarray, moduli: list[int], scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(floor)
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = integers(batch.column(0), width, scale, shift, LIMIT) - floor
            for i in range(0, len(x), ROWS):
                for p in moduli:
                    r = (x[i : i + ROWS] % p).astype(np.float64)
                    total[p] = (total.get(p, 0) + (r.T @ r).astype(np.int64)) % p
        for p, t in total.items():
            for at in range(0, width, COLUMNS):
                piece = np.zeros((width, COLUMNS), np.int64)
                piece[:, : min(COLUMNS, width - at)] = t[:, at : at + COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array([p] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([at] * width, pa.int32()), pa.array(list(piece), pa.list_(pa.int64()))], names=["prime", "i", "at", "sums"])

    return run


def exact_scatter(vectors: DataFrame, n: int, sums: list[int], low: list[int], high: list[int], scale: int = SCALE, shift: int = SHIFT) -> list[list[int]]:
    """n^2 times the covariance of the rows (vector), in integers: n * sum(d d') - sum(d) sum(d)' with d = x - floor(mean)."""
    width = len(sums)
    floor = [s // n for s in sums]
    far = max(max(h - f, f - lo) for lo, h, f in zip(low, high, floor, strict=True))
    moduli = primes(2 * n * far * far)
    partial = vectors.mapInArrow(_products(np.array(floor, np.int64), moduli, scale, shift), "prime int, i int, at int, sums array<long>")
    merged = partial.groupBy("prime", "i", "at").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(COLUMNS)]).alias("sums"))
    residues = {p: np.zeros((width, width), object) for p in moduli}
    for r in merged.collect():  # primes * dimensions * dimensions values, whatever the number of rows
        take = min(COLUMNS, width - r["at"])
        residues[r["prime"]][r["i"], r["at"] : r["at"] + take] = [s % r["prime"] for s in r["sums"][:take]]
    rest = [s - n * f for s, f in zip(sums, floor, strict=True)]
    return [[n * chinese([residues[p][i, j] for p in moduli], moduli) - rest[i] * rest[j] for j in range(width)] for i in range(width)]


def fit_whitening(vectors: DataFrame, width: int, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of all rows (vector) of one dimension. Rows are reduced to sums over dimensions before they are shuffled."""
    spec = "dim int, n long, sum long, low long, high long"
    merged = vectors.mapInArrow(_moments(width, scale, shift), spec).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(merged.collect(), key=lambda r: r["dim"])  # one row a dimension
    n, sums, low, high = rows[0]["n"], [int(r["sum"]) for r in rows], [r["low"] for r in rows], [r["high"] for r in rows]
    scatter = exact_scatter(vectors, n, sums, low, high, scale, shift)
    covariance = np.array([[v / (n * n) for v in line] for line in scatter])
    values, unit = np.linalg.eigh(covariance)
    values, unit = np.maximum(values[::-1], 0.0), unit[:, ::-1]
    some = values > width * np.finfo(np.float64).eps * max(values[0], np.finfo(np.float64).tiny)
    root = np.where(some, np.sqrt(np.where(some, values, 1.0)), np.nan)
    return Whitening(n, sums, low, high, covariance, values, (unit / root)[:, :components])


def _centred(column: pa.Array, w: Whitening, scale: int, shift: int) -> tuple[np.ndarray, list[int | None]]:
    """x - mean as doubles, from the exact n * x - sum, and the sum of the squares of the latter (None over 63 bits)."""
    floor = w.floor
    rest = np.array([s - w.n * int(f) for s, f in zip(w.sums, floor, strict=True)], np.int64)
    d = integers(column, len(floor), scale, shift, LIMIT) - floor
    far = max(max(h - int(f), int(f) - lo) for lo, h, f in zip(w.low, w.high, floor, strict=True))
    if len(floor) * (w.n * (far + 1)) ** 2 < 1 << 63:
        t = w.n * d - rest
        return t / w.n, (t * t).sum(1).tolist()
    t = d.astype(object) * w.n - rest.astype(object)
    squares = [int(x) for x in (t * t).sum(1)]
    return (t / w.n).astype(np.float64), [x if x < 1 << 63 else None for x in squares]


def _gram(shared, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = shared.value
        size = w.project.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            y = _centred(batch.column(0), w, scale, shift)[0] @ w.project
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def identity_error(vectors: DataFrame, w: Whitening, scale: int = SCALE, shift: int = SHIFT) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, over the components with variance; None if
    there is none. Rows are centred on the exact mean before they are projected, so that the whitened ones have mean 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(w)
    size = w.project.shape[1]
    merged = vectors.mapInArrow(_gram(shared, scale, shift), "i int, sums array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).alias("sums"))
    gram = np.array([r["sums"] for r in sorted(merged.collect(), key=lambda r: r["i"])])  # components * components values
    some = ~np.isnan(w.project[0])
    off = np.abs(gram / w.n - np.eye(size))[np.ix_(some, some)]
    return float(off.max()) if off.size else None


def _project(shared, scale: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = shared.value
        size = w.project.shape[1]
        for batch in batches:
            centred, squares = _centred(batch.column(1), w, scale, shift)
            flat = pa.array((centred @ w.project).ravel(), pa.float64(), from_pandas=True)  # nan, for no variance, becomes null
            ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["id", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None, float | None]:
    """((id, deviation, whitened), what was fitted, identity error) of the rows with a finite vector.

    `whitened` holds up to `components` values, `deviation` the sum of (n * x - sum)^2 over the dimensions, null where it
    leaves 64 bits. Rows whose vector is null or has null or non-finite components are dropped. Vectors of another length
    than the most frequent one aren't fitted and stay with nulls. A component without variance has null values. Null and
    repeated ids count as rows of their own; other columns are ignored, whatever their names; an empty table has no rows and
    nothing fitted. Components past some 2^40 / `scale` fail in place of wrong numbers.
    """
    kept, width = kept_vectors(df, {id_col: "id"}, vector_col)
    nothing = kept.select("id", F.lit(None).cast("long").alias("deviation"), F.array_repeat(F.lit(None).cast("double"), min(components, width)).alias("whitened"))
    if not width:
        return nothing.withColumnRenamed("id", id_col), None, None
    same = kept.where(F.size("vector") == width)
    fitted = fit_whitening(same.select("vector"), width, components, scale, shift)
    off = identity_error(same.select("vector"), fitted, scale, shift)
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    spec = nothing.schema
    out = same.select("id", "vector").mapInArrow(_project(shared, scale, shift), spec).unionByName(nothing.where(F.size(kept["vector"]) != width))
    return out.withColumnRenamed("id", id_col), fitted, off


def whitened_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each row of `whiten` and component,
    from 1 by falling eigenvalue; `explained` is the eigenvalue's share of the trace, null if that is 0."""
    rows, w, off = whiten(df, id_col, vector_col, components)
    trace = float(np.trace(w.covariance)) if w else 0.0
    shares = [float(v / trace) for v in w.values[:components]] if trace else []
    each = rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "value"))
    explained = F.element_at(F.lit(shares), F.col("at") + 1) if shares else F.lit(None).cast("double")
    n = F.lit(w.n if w else 0).cast("long")
    return each.select(id_col, (F.col("at") + 1).alias("component"), n.alias("n"), "deviation", F.col("value").alias("whitened"), explained.alias("explained"), F.lit(off).cast("double").alias("identity_error"))
