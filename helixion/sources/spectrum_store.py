"""Saved spectra: Parquet, with k, fingerprint width and mode beside the counts, so that a reader can't mix them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(spectrum: DataFrame, path: str, k: int, hb: int | None = None) -> None:
    """hb: fingerprint width, None for exact k-mers."""
    spectrum.write.mode("overwrite").parquet(f"{path}/counts")
    spectrum.sparkSession.createDataFrame([(k, hb)], "k int, hb int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """The counts; lazily scanned. Asking for another k than the saved one is an error."""
    about = spark.read.parquet(f"{path}/about").first()
    if k is not None and about["k"] != k:
        raise ValueError(f"the spectrum has k = {about['k']}, not {k}")
    return spark.read.parquet(f"{path}/counts")


def about(spark: SparkSession, path: str) -> DataFrame:
    """One row: k, hb, distinct keys, occurrences, largest count."""
    c = spark.read.parquet(f"{path}/counts").agg(F.count("*").alias("n_distinct"), F.sum("cnt").alias("n_total"), F.max("cnt").alias("max_cnt"))
    return spark.read.parquet(f"{path}/about").join(c)


def default_name(k: int, threads: int, qb: int) -> str:
    return f"k{k}.t{threads}.s{qb}.ser"
