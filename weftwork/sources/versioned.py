"""Tables that change without being rewritten: rows in buckets by a hash of their key, and a manifest for each version.

A change writes the buckets that it touches into a new folder and then one manifest, which names the folder of every bucket.
Readers take the last whole manifest, so that a driver which is lost before its manifest leaves the old table as it was.
Manifests are numbered and never overwritten: of two writers that start from one version the second starts again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import upsert
from ..scratch import fresh_names, materialize, release

BUCKETS = 16
#: How often a change starts again when another writer was first.
TRIES, PAUSE = 5, 0.5
#: Seconds after which the lock of a writer counts as left behind.
STALE = 600


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class Version(NamedTuple):
    """A version of a table: its number, key columns, number of buckets, the schema, and the folder of each bucket that has rows."""

    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    folders: dict[int, str]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies in a folder."""
    p, fs = _fs(spark, folder)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(p)] if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    names = [n for n, _ in _files(spark, f"{path}/manifests")]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _read(spark: SparkSession, path: str, number: int) -> Version:
    p, fs = _fs(spark, f"{path}/manifests/{number:010d}.json")
    stream = fs.open(p)
    try:
        m = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
    return Version(number, tuple(m["keys"]), m["buckets"], StructType.fromJson(m["schema"]), {int(k): v for k, v in m["folders"].items()})


def current(spark: SparkSession, path: str) -> Version | None:
    """The last version of the table at `path`; None if there is none."""
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[0]) if numbers else None


def _commit(spark: SparkSession, path: str, after: Version | None, version: Version) -> None:
    """Make `version` the current one; a Conflict if another one has come after `after`, or is just coming.

    A writer first makes the lock of its number, which only one can, and then moves its manifest into place in one step. A
    lock without a manifest that is older than `STALE` seconds is that of a lost writer and is passed over.
    """
    folder, last = f"{path}/manifests", after.number if after else 0

    def behind() -> bool:
        return max(_numbers(spark, path), default=0) != last

    locks = {int(n[:-5]): t for n, t in _files(spark, folder) if n.endswith(".lock") and int(n[:-5]) > last}
    if behind() or any(t > (time.time() - STALE) * 1000 for t in locks.values()):
        raise Conflict(f"another writer changes {path}")
    number = max(locks, default=last) + 1
    lock, fs = _fs(spark, f"{folder}/{number:010d}.lock")
    if fs.exists(lock) or not fs.createNewFile(lock):
        raise Conflict(f"another writer changes {path}")
    if behind():
        fs.delete(lock, False)
        raise Conflict(f"another writer has changed {path}")
    body = json.dumps({"keys": version.keys, "buckets": version.buckets, "schema": version.schema.jsonValue(), "folders": version.folders}, ensure_ascii=False)
    part = _fs(spark, f"{folder}/{uuid.uuid4().hex}.part")[0]
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    if not fs.rename(part, _fs(spark, f"{folder}/{number:010d}.json")[0]):
        raise Conflict(f"version {number} of {path} can't be put into place")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[int, str]:
    """Write rows into a new folder, one below it for each bucket; bucket -> folder, relative to `path`."""
    spark = df.sparkSession
    (b,) = fresh_names(df, "weft_bucket")
    folder = f"data/{uuid.uuid4().hex}"
    rows = df.withColumn(b, bucket_of(keys, buckets))
    (rows.hint("rebalance", b) if keys else rows).write.partitionBy(b).parquet(f"{path}/{folder}")
    names = [n for n, _ in _files(spark, f"{path}/{folder}")]
    return {int(n.partition("=")[2]): f"{folder}/{n}" for n in names if n.startswith(f"{b}=")}


def read_version(spark: SparkSession, path: str, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets only."""
    folders = [f"{path}/{f}" for b, f in sorted(version.folders.items()) if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], version.schema)
    return spark.read.schema(version.schema).parquet(*folders)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path` as it is now; None if there is none."""
    version = current(spark, path)
    return None if version is None else read_version(spark, path, version)


def replace_table(df: DataFrame, path: str, keys: Sequence[str] = (), buckets: int = BUCKETS) -> Version:
    """Make `df` the whole table, whatever was there, which `df` may read."""
    spark = df.sparkSession
    before = current(spark, path)
    n = buckets if keys else 1
    folders = _write(df, path, keys, n)
    version = Version((before.number if before else 0) + 1, tuple(keys), n, df.schema, folders)
    _commit(spark, path, before, version)
    return version


def _changed(spark: SparkSession, path: str, change: Callable[[Version], dict[int, str | None]]) -> Version:
    for left in range(TRIES, 0, -1):
        before = current(spark, path)
        if before is None:
            raise FileNotFoundError(f"there is no table at {path}")
        folders = {b: f for b, f in (before.folders | change(before)).items() if f is not None}
        version = before._replace(number=before.number + 1, folders=folders)
        try:
            _commit(spark, path, before, version)
            return version
        except Conflict:
            if left == 1:
                raise
            time.sleep(PAUSE)
    raise AssertionError


def upsert_table(new: DataFrame, path: str, order: Sequence[str] = (), columns: Sequence[str] | None = None) -> Version:
    """Replace rows by those of `new` that have their key, and add the others; of several new ones with a key the last by
    `order` wins. With `columns` only these columns of a row that is there change; a new row comes in whole. Only buckets
    that have a key of `new` are read and written; keys must not be null."""
    spark = new.sparkSession
    kept = materialize(new, "changes")

    def change(before: Version) -> dict[int, str | None]:
        keys = list(before.keys)
        touched = [r[0] for r in kept.select(bucket_of(keys, before.buckets)).distinct().collect()]  # one a bucket
        base = read_version(spark, path, before, touched)
        rows = kept.select(*base.columns)
        if columns is not None:
            last = upsert(base.limit(0), rows, keys, order)
            there, fresh = fresh_names(base, "weft_there", "weft_new")
            both = base.withColumn(there, F.lit(True)).alias("old").join(last.withColumn(fresh, F.lit(True)).alias("new"), keys, "full_outer")

            def value(c: str) -> Column:
                replaced = F.col(fresh).isNotNull() if c in columns else F.col(there).isNull()
                return F.when(replaced, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

            out = both.select(*[c if c in keys else value(c).alias(c) for c in base.columns])
        else:
            out = upsert(base, rows, keys, order)
        return dict.fromkeys(touched) | _write(out, path, keys, before.buckets)

    try:
        return _changed(spark, path, change)
    finally:
        release(kept)


def replace_keys(new: DataFrame, path: str, gone: DataFrame) -> Version:
    """Take out all rows whose key is in `gone` (keys) or among those of `new`, and add the rows of `new`, of which several may
    have one key. Only buckets that have one of these keys are read and written."""
    spark = new.sparkSession
    kept = materialize(new, "changes")

    def change(before: Version) -> dict[int, str | None]:
        keys = list(before.keys)
        out_of = gone.select(*keys).unionByName(kept.select(*keys)).distinct()
        touched = [r[0] for r in out_of.select(bucket_of(keys, before.buckets)).distinct().collect()]  # one a bucket
        base = read_version(spark, path, before, touched)
        return dict.fromkeys(touched) | _write(base.join(out_of, keys, "left_anti").unionByName(kept.select(*base.columns)), path, keys, before.buckets)

    try:
        return _changed(spark, path, change)
    finally:
        release(kept)


def delete_rows(spark: SparkSession, path: str, condition: Column) -> tuple[Version, int]:
    """Delete the rows for which a condition holds (null: it doesn't); (version, how many). Buckets without one stay as they
    are. Counting reads the columns of the condition alone."""
    gone = 0

    def change(before: Version) -> dict[int, str | None]:
        nonlocal gone
        keys = list(before.keys)
        held = read_version(spark, path, before).where(condition).groupBy(bucket_of(keys, before.buckets).alias("b")).agg(F.count("*").alias("n")).collect()  # one a bucket
        gone, touched = sum(r["n"] for r in held), [r["b"] for r in held]
        if not touched:
            return {}
        return dict.fromkeys(touched) | _write(read_version(spark, path, before, touched).where(~F.coalesce(condition, F.lit(False))), path, keys, before.buckets)

    return _changed(spark, path, change), gone


def vacuum(spark: SparkSession, path: str, keep: int = 1, older: float = STALE) -> int:
    """Remove what the last `keep` versions don't name: older manifests, locks and folders of data. What has changed in the
    last `older` seconds stays, as a writer may be at it. Gives the number of folders removed."""
    before = (time.time() - older) * 1000
    versions = [_read(spark, path, n) for n in _numbers(spark, path)[:keep]]
    named = {f.split("/")[1] for v in versions for f in v.folders.values()}
    numbers = {v.number for v in versions}
    _, fs = _fs(spark, path)
    for name, at in _files(spark, f"{path}/manifests"):
        if at < before and not (name[:-5].isdigit() and int(name[:-5]) in numbers):
            fs.delete(_fs(spark, f"{path}/manifests/{name}")[0], False)
    d, _ = _fs(spark, f"{path}/data")
    if not fs.exists(d):
        return 0
    old = [f.getPath() for f in fs.listStatus(d) if f.getPath().getName() not in named and f.getModificationTime() < before]
    for f in old:
        fs.delete(f, True)
    return len(old)
