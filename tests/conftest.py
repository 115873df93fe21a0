import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="session")
def compare(spark, duck):
    def run(query, sql):
        df = query(spark, SF)
        got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()]
        assert sorted(df.columns) == sorted(names)
        assert sorted(got) == sorted(want)

    return run
