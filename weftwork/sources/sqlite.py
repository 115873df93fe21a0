"""Tables of SQLite files, read without a driver: each file is opened in memory by the task that has its bytes."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

_CASTS = {BooleanType: bool, DoubleType: float, FloatType: float, IntegerType: int, LongType: int, ShortType: int, StringType: str, BinaryType: bytes}
_ROWS = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _table(table: str, fields: list[tuple[str, type, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", *(n for n, _, _ in fields)]
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(data.as_py())
                    have = {r[1].lower() for r in db.execute(f"PRAGMA table_info({_quoted(table)})")}
                    if not have:
                        continue
                    wanted = [_quoted(n) if n.lower() in have else "NULL" for n, _, _ in fields]
                    rows = db.execute(f"SELECT {', '.join(wanted)} FROM {_quoted(table)}")
                    while part := rows.fetchmany(_ROWS):
                        columns = [pa.array([None if v is None else cast(v) for v in c], t) for c, (_, cast, t) in zip(zip(*part, strict=True), fields, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part), pa.string()), *columns], names=names)
                except sqlite3.DatabaseError as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                finally:
                    db.close()

    return run


def tables(files: DataFrame, table: str, schema: str) -> DataFrame:
    """(path, and the columns of `schema`) of a table in every database of (path, content).

    Columns that a file lacks are null, files without the table give no rows, and a file that is no database is an error
    with its path. A file is one task's work.
    """
    wanted = StructType.fromDDL(schema)
    unknown = [f.name for f in wanted.fields if type(f.dataType) not in _CASTS]
    if unknown:
        raise ValueError(f"no SQLite type for {', '.join(unknown)}")
    fields = [(f.name, _CASTS[type(f.dataType)], to_arrow_type(f.dataType)) for f in wanted.fields]
    return files.select("path", "content").mapInArrow(_table(table, fields), StructType.fromDDL(f"path string, {schema}"))


def read_table(spark: SparkSession, folder: str, table: str, schema: str, pattern: str = "*.{db,sqlite,sqlite3}") -> DataFrame:
    """`tables` of the files below a folder, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return tables(files.where(F.col("length") > 0), table, schema)


#: Columns of the table of platform methods (fixed names).
PLATFORM_METHODS = "name string, signature string, description string, server boolean, thin_client boolean, web_client boolean, mobile_client boolean, external_connection boolean"


def platform_methods(spark: SparkSession, folder: str) -> DataFrame:
    """The methods of the platform, as `operators.rules.availability` takes them; of rows that repeat a name one stays."""
    return read_table(spark, folder, "platform_methods", PLATFORM_METHODS).drop("path").dropDuplicates(["name"])
