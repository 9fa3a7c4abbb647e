"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf_dir):
        c = duckdb.connect()
        c.sql("SET timezone = 'UTC'")
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return c

    return connect


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and a DuckDB relation have the same columns and the same bag of rows."""

    def check(df, rel):
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        key = lambda r: [(v is None, repr(v)) for v in r]
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
        at = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
        assert got == want

    return check
