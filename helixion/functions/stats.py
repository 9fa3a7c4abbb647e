"""Assembly and vector statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixion.plans.lineage import cut


def length_sums(lengths: DataFrame, column: str = "len") -> DataFrame:
    """len, n, upto: distinct lengths, and the sum of all lengths at least as long.

    Equal lengths are counted first, so the running sum goes over distinct
    lengths only, however many sequences there are.
    """
    by = lengths.groupBy(F.col(column).alias("len")).agg(F.count("*").alias("n"))
    return by.withColumn("upto", F.sum(F.col("len") * F.col("n")).over(W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)))


def ngx(lengths: DataFrame, x: int, ref_len: int, column: str = "len") -> DataFrame:
    """One row ``ngx``: the greatest length whose running sum reaches x percent of ref_len; null if none does."""
    return length_sums(lengths, column).agg(F.max(F.when(F.col("upto") >= ref_len * x // 100, F.col("len"))).alias("ngx"))


def contig_summary(lengths: DataFrame, ref_len: int = 4_800_000, column: str = "len") -> DataFrame:
    """One row: n_contigs, total, shortest, longest, n50 (at half the total) and ng50 (at half of ref_len; 0 where not reached)."""
    s = length_sums(lengths, column)
    total = s.agg(F.sum(F.col("len") * F.col("n")).alias("total")).scalar()
    reach = lambda at: F.max(F.when(F.col("upto") >= at, F.col("len")))
    return s.withColumn("total", total).agg(
        F.sum("n").alias("n_contigs"), F.max("total").alias("total"), F.min("len").alias("shortest"), F.max("len").alias("longest"),
        F.coalesce(reach(F.floor(F.col("total") / 2)), F.lit(0)).alias("n50"), F.coalesce(reach(F.lit(ref_len // 2)), F.lit(0)).alias("ng50"),
    )


def median(x: Column | str) -> Column:
    """Average of the two middle values for an even count; 0 for none."""
    return F.coalesce(F.median(x), F.lit(0.0))


def sum_sq_dev(x: Column | str) -> Column:
    """Sum of squared deviations from the mean, not divided."""
    return F.var_pop(x) * F.count(x)


def mean(x: Column | str) -> Column:
    return F.avg(x)


def pearson(x: Column | str, y: Column | str) -> Column:
    return F.corr(x, y)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def subtract_scalar(a: Column, x: float) -> Column:
    return F.transform(a, lambda v: v - F.lit(x))


def add_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def argsort(df: DataFrame, value: str, tie: str) -> DataFrame:
    """df with ``rank`` from 0, ascending by value, then tie."""
    return number(df, [value, tie], "rank")


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in an order: ranges are sorted apart, then offset by the partitions' totals; no window spans all rows."""
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    totals = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # The written table stays for those who read the result.
    return ordered.withColumn("_part", part).join(totals.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def jaccard_bits(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two masks; NaN if both are empty."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(float("nan"))).otherwise(F.bit_count(a.bitwiseAND(b)) / F.nullif(either, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0))


def sketch_jaccard(a: Column, b: Column, n: int) -> Column:
    """MinHash estimate from two ascending sketches: of the n least of both, the share that is in each."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, n)
    return F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.nullif(F.size(least), F.lit(0))
