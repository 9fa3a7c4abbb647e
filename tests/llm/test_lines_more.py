"""Line deduplication: against SQL on nulls and odd rows, clashing columns, long texts."""

from pyspark.sql import functions as F

from helixion.llm import lines
from helixion.llm.common import Scratch

SCHEMA = "doc_id long, text string"


def test_null_texts_equal_the_sql(spark, same):
    import duckdb

    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (5, "a\nb"), (6, "\n\n\n\n"), (7, "q q\nb\nc\nq q\nb\nc\nq q\nb\nc"), (8, None)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(lines.op8(spark, spark.createDataFrame(rows, SCHEMA)), con.sql(lines.ORACLE))


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], SCHEMA).withColumns({c: F.lit("x") for c in ("clean", "n_lines", "N_Removed", "_row", "_0", "marked", "m")})
    out = lines.dedup_lines(Scratch(spark, "t"), df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_row", "_0", "marked", "m", "clean", "n_lines", "n_removed"])
    assert sorted((r.doc_id, r.clean, r.n_lines, r.n_removed) for r in out.collect()) == [(1, "a\nb\nc", 3, 0), (2, "", 3, 3)]


def test_long_texts(spark):
    long = "\n".join(f"line {i % 50000}" for i in range(100_000))
    got = lines.dedup_lines(Scratch(spark, "t"), spark.createDataFrame([(1, long), (2, "z")], SCHEMA)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in got} == {1: (100_000, 50_000), 2: (1, 0)}
