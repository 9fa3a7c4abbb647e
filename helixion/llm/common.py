"""What the training-data operators share: scratch storage, word splitting, bit tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixion.plans.ship import ship

#: A word is a run of anything but these (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Shingle length and similarity for all near-duplicate decisions on words.
SHINGLE_WORDS = 5
MIN_SIMILARITY_PERCENT = 75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a new folder; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixion-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive any executor.

    ``cut`` writes and rereads a frame; ``drop`` deletes one as soon as no later
    plan reads it, so that peak disk stays near the size of the largest step.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of frames that are gone; else they stay until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.delete(df._scratch_path)


def words(text: Column) -> Column:
    """Array of words of the whole text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def beside(df: DataFrame, *added: str) -> list[Column]:
    """df's columns but those that a result adds under the same name (in any case): the added ones stand."""
    names = {a.lower() for a in added}
    return [df[c] for c in df.columns if c.lower() not in names]


#: A bit table has 2^TABLE_LOG2 words of 64 bits: 512 kB, whatever it holds.
TABLE_LOG2 = 16


def _probes(h: Column) -> tuple[Column, Column]:
    """Two bit positions, from disjoint bits of a hash."""
    mask = F.lit((1 << (TABLE_LOG2 + 6)) - 1)
    return h.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int")


def bit_table(df: DataFrame, h: Column) -> DataFrame:
    """One row, ``bits``: a Bloom filter of fixed size over the 64-bit hashes h.

    Its size is proven, so it may go to every task; as it fills up it lets more
    pass, never less, so what it screens needs an exact step behind it.
    """
    at = df.select(F.explode(F.array(*_probes(h))).alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("v"))
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit((1 << TABLE_LOG2) - 1))).alias("k"))
    full = grid.join(at, "k", "left").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("t"))
    return full.select(F.transform("t", lambda x: x["v"]).alias("bits"))


def in_bits(bits: Column, h: Column) -> Column:
    """Whether a hash may be in the table; false is certain."""
    a, b = _probes(h)
    test = lambda p: F.call_function("getbit", F.get(bits, F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1
    return test(a) & test(b)


def touched(scratch: Scratch, rows: DataFrame, key: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the marked keys, rows that surely have none): only the first need a join, and its shuffle.

    marks has one column. A bit table of fixed size tells them apart; as it
    fills up, more rows go the long way, with the same result.
    """
    bits = scratch.cut(bit_table(marks, F.xxhash64(marks[marks.columns[0]])), "touched").scalar()
    may = in_bits(bits, F.xxhash64(key))
    return rows.filter(may), rows.filter(~may)


def over(sql: str, table_name: str, rows: str) -> str:
    """A DuckDB text that begins with WITH, read over other rows under a table's name."""
    head = "WITH RECURSIVE " if sql.lstrip().startswith("WITH RECURSIVE ") else "WITH "
    return sql.replace(head, f"{head}{table_name} AS ({rows}), ", 1)
