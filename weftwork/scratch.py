"""Tables in the folder that all executors share, for plans that read one result several times or in rounds."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_own: list[str] = []
_kept: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    A session without one gets a folder of this machine only where all its tasks run here (a local master, as in tests);
    on a cluster that would be another disk on each machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        _own.append(tempfile.mkdtemp(prefix="weftwork-"))
        named = f"file://{_own[-1]}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends if nothing has freed it before."""
    path = f"{shared_dir(spark)}/weftwork/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete `path` through Hadoop's file system, so that it works on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder or file of one store."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} can't be moved to {to}")


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Free the files of tables from `materialize` whose last reader has run; other frames and None are left alone."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path in _made:
            remove(_made[path], path)


@contextmanager
def scope() -> Iterator[None]:
    """Free, at the end, the scratch tables that were made inside and that `release` hasn't freed: for sessions that run many
    queries and are done with each result. What `kept` holds stays."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before and p not in _kept.values()]:
            remove(_made[path], path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """What changes when a file below one of the paths does: names, sizes and times of all of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def kept(spark: SparkSession, kind: str, sources: Sequence[str], build: Callable[[str], object]) -> str:
    """The path of what `build(path)` made of these sources: built once in a session, and again after a source has changed."""
    key = (spark.sparkContext.applicationId, kind, fingerprint(spark, *sources))
    if key not in _kept:
        path = new_path(spark, kind)
        build(path)
        _kept[key] = path
    return _kept[key]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores added until no column of `df` has it; Spark's names don't tell cases apart."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        if spark.sparkContext._jsc is None:  # the session was stopped before Python ended; what lies here can still go
            local = path.removeprefix("file://").removeprefix("file:")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)
            continue
        try:
            remove(spark, path)
        except (OSError, PySparkException):  # the JVM may have ended before Python; the next path is still tried
            continue
        except Exception as e:
            if type(e).__module__.partition(".")[0] != "py4j":
                raise
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)
