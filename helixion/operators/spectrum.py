"""K-mer spectra: rows (kmer, cnt), or (key, cnt) in fingerprint mode. Keys are unique in a spectrum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count(kmers: DataFrame, key: str = "kmer") -> DataFrame:
    """Occurrences of each key; partial sums go into the one shuffle, so frequent k-mers are no hot keys."""
    return kmers.groupBy(key).agg(F.count("*").alias("cnt"))


def add(counts: DataFrame, key: str = "kmer") -> DataFrame:
    """Rows (key, cnt) with repeated keys, summed."""
    return counts.groupBy(key).agg(F.sum("cnt").alias("cnt"))


def denoise(spectrum: DataFrame) -> DataFrame:
    """Drops keys seen once."""
    return spectrum.filter(F.col("cnt") > 1)


def solid(spectrum: DataFrame, low: int = 2, high: int = 1_000_000) -> DataFrame:
    return spectrum.filter(F.col("cnt").between(low, high))


def lookup(spectrum: DataFrame, keys: DataFrame, key: str = "kmer") -> DataFrame:
    """keys with cnt, 0 where absent."""
    return keys.join(spectrum, key, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def merge(*spectra: DataFrame, key: str = "kmer") -> DataFrame:
    """Union with counts summed, in one shuffle for any number of spectra."""
    return add(reduce(DataFrame.unionByName, spectra), key)


def beside(a: DataFrame, b: DataFrame, key: str = "kmer") -> DataFrame:
    """key, x, y: counts in a and in b, 0 where absent; one grouping of both.

    a and b may be spectra or rows to be counted with a column cnt: counts of a
    key are summed, so nothing needs to be grouped before.
    """
    zero = F.lit(0).cast("long")
    both = a.select(key, F.col("cnt").alias("x"), zero.alias("y")).unionByName(b.select(key, zero.alias("x"), F.col("cnt").alias("y")))
    return both.groupBy(key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def intersect(a: DataFrame, b: DataFrame, key: str = "kmer", counts: str = "left") -> DataFrame:
    """Keys of both. counts: of a (left), or the lesser of the two (min)."""
    both = beside(a, b, key).filter("x > 0 AND y > 0")
    return both.select(key, (F.col("x") if counts == "left" else F.least("x", "y")).alias("cnt"))


def remove(spectrum: DataFrame, deltas: DataFrame, key: str = "kmer") -> DataFrame:
    """Subtracts counts; a key that falls to 0 or below goes."""
    return merge(spectrum, deltas.withColumn("cnt", -F.col("cnt")), key=key).filter("cnt > 0")


def delete(spectrum: DataFrame, keys: DataFrame, key: str = "kmer") -> DataFrame:
    return spectrum.join(keys.select(key), key, "left_anti")


def replace(spectrum: DataFrame, counts: DataFrame, key: str = "kmer") -> DataFrame:
    """Sets counts; keys of ``counts`` win."""
    return delete(spectrum, counts, key).unionByName(counts.select(key, "cnt"))


def inner_product(a: DataFrame, b: DataFrame, key: str = "kmer") -> DataFrame:
    """One row ``dot``: sum of products over common keys, 0 if there is none."""
    return beside(a, b, key).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0).cast("long")).alias("dot"))


def magnitude(a: DataFrame) -> DataFrame:
    """One row ``magnitude``: whole part of the root of the sum of squares."""
    return a.agg(F.coalesce(F.floor(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")))), F.lit(0)).cast("long").alias("magnitude"))


def cosine(a: DataFrame, b: DataFrame, key: str = "kmer") -> DataFrame:
    """One row ``cosine``; both sides are read once, grouped by key once."""
    return beside(a, b, key).agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double") * F.sum(F.col("y") * F.col("y")).cast("double"))).alias("cosine"))


def metadata(spectrum: DataFrame) -> DataFrame:
    """One row: distinct keys, occurrences, largest count."""
    return spectrum.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("n_total"), F.max("cnt").alias("max_cnt"))


def histogram(spectrum: DataFrame) -> DataFrame:
    """cnt, n_kmers: how many keys have each count."""
    return spectrum.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def moments(spectrum: DataFrame) -> DataFrame:
    """f0 (distinct), f1_total (occurrences), and keys seen once, twice and three times."""
    times = lambda n: F.count_if(F.col("cnt") == n).alias(f"f{n}")
    return spectrum.agg(F.count("*").alias("f0"), F.coalesce(F.sum("cnt"), F.lit(0).cast("long")).alias("f1_total"), times(1), times(2), times(3))


def scan(spectrum: DataFrame, start=None, key: str = "kmer") -> DataFrame:
    """Ordered by key; from ``start`` on if given."""
    return (spectrum if start is None else spectrum.filter(F.col(key) >= F.lit(start))).orderBy(key)
