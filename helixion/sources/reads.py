"""Reads from lists of files, FASTQ and FASTA."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixion.plans.lineage import hadoop

SCHEMA = "path string, read_id long, seq string"


def read_list(path: str, relative: bool = False) -> list[str]:
    """Paths named in a text file, one a line, blank lines skipped; relative: to the list's own folder. A missing list is an error."""
    with open(path) as f:
        names = [x.strip() for x in f if x.strip()]
    return [os.path.join(os.path.dirname(path), x) for x in names] if relative else names


def _records(lines: Iterator[str]) -> Iterator[str]:
    """Second line of each four."""
    for i, line in enumerate(lines):
        if i % 4 == 1:
            yield line


class FastqReader(DataSourceReader):
    def __init__(self, paths: list[str], skip_missing: bool):
        self.paths, self.skip = paths, skip_missing

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import bz2
        import gzip

        path = partition.value
        kind = gzip.open if path.endswith(".gz") else bz2.open if path.endswith((".bz2", ".bz")) else open
        try:
            f = kind(path, "rt", newline=None)
        except OSError:
            if self.skip:
                return
            raise
        with f:
            at, rows = 0, []
            for seq in _records(x.rstrip("\n") for x in f):
                rows.append(seq)
                if len(rows) == 8192:
                    yield self.batch(path, at, rows)
                    at, rows = at + len(rows), []
            if rows:
                yield self.batch(path, at, rows)

    @staticmethod
    def batch(path: str, at: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.string())], ["path", "read_id", "seq"])


class FastqSource(DataSource):
    """``fastq``: options paths (newline-separated) and skipMissing. A partition a file; for local or mounted files."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader([p for p in self.options["paths"].split("\n") if p], self.options.get("skipmissing", "false") == "true")


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in any store that Spark reads."""
    found = []
    for p in paths:
        fs, path = hadoop(spark, p)
        if fs.exists(path):
            found.append(p)
    return found


def fastq_records(spark: SparkSession, paths: list[str], skip_missing: bool = False) -> DataFrame:
    """path, read_id, seq by Spark's own text reader: any store Spark reads, gzip and bzip2 by extension, plain files split. skip_missing: paths that don't exist are left out, else they are an error.

    Four-line framing needs a line's number in its file: lines are numbered in
    their split, and splits are offset by the line totals before them.
    """
    from pyspark.sql import Window as W

    from helixion.plans.lineage import cut

    paths = present(spark, paths) if skip_missing else paths
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    lines = cut(spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("seq")))
    totals = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = lines.join(totals.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "seq")
    return line.filter("line % 4 = 1").select("path", F.expr("line div 4").alias("read_id"), "seq")


def fastq(spark: SparkSession, paths: list[str], skip_missing: bool = False) -> DataFrame:
    """Like ``fastq_records``, by the Python data source: a task a file, nothing buffered between stages."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("paths", "\n".join(paths)).option("skipMissing", str(skip_missing).lower()).load()


def fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, header, seq of FASTA files whose sequences may be wrapped: records are split at ``>`` at a line start, so each is one row of one task."""
    text = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("v"))
    return text.filter(F.length("v") > 0).select(
        "path", F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "").alias("header"), F.regexp_replace(F.expr("substr(v, length(substring_index(v, '\n', 1)) + 1)"), "[\r\n]", "").alias("seq")
    )
