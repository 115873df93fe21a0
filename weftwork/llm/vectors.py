"""Tables of vectors: the rows that can be computed with, and their components as exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def usable(vector: Column) -> Column:
    """A vector that isn't null and has only finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def kept_vectors(df: DataFrame, columns: dict[str, str], vector_col: str) -> tuple[DataFrame, int]:
    """(rows with a usable vector, written; their dimension).

    Rows have the columns of `columns` (own name -> new name) and `vector`, of floats or doubles. The dimension is the most
    frequent length, of equally frequent ones the greatest; 0 without rows.
    """
    kind = df.select(vector_col).schema[0].dataType
    wide = kind.simpleString() in ("array<float>", "array<double>")
    vector = F.col(vector_col) if wide else F.col(vector_col).cast("array<double>")
    kept = materialize(df.select(*[F.col(c).alias(n) for c, n in columns.items()], vector.alias("vector")).where(usable(F.col("vector"))), "vectors")
    most = kept.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), F.col("width").desc()).first()
    return kept, most["width"] if most else 0


def integers(column: pa.Array, width: int, scale: int, shift: int = 0, limit: int = 1 << 62) -> np.ndarray:
    """floor(scale * c) + shift of each component c, as a matrix of int64. Beyond `limit` sums would leave 64 bits, which is
    an error and never a wrong number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    floor = np.floor(flat * scale)
    if floor.size and np.abs(floor).max() + abs(shift) >= limit:
        raise OverflowError(f"a component is beyond what exact 64-bit sums allow: {np.abs(flat).max()}")
    return floor.astype(np.int64) + shift
