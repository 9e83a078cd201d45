from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return "%.9g" % v
    return str([_plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query's rows with its SQL's on a folder of tables."""
    import duckdb

    def compare(query, sql, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        want = sorted(tuple(_plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
        assert got == want

    return compare
