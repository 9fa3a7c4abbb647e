import random

import numpy as np
from pyspark.sql import functions as F

from helixion.functions import dna, hashing, stats
from helixion.operators import similarity as J
from helixion.plans import catalog

GOLDEN = {  # forward, reverse, canonical
    "ATGC": ("30fd466de7b75ffd", "979c4e03f857f8af", "30fd466de7b75ffd"),
    "atgN": ("016e87e8851774b1", "960db887eaeee18e", "016e87e8851774b1"),
    "ACGTACGT": ("f93f120bd434447b", "f93f120bd434447b", "f93f120bd434447b"),
    "AAAAA": ("9b5384bf1b0279ae", "01542d341299ba71", "01542d341299ba71"),
    "GATTACA": ("ef8d84dbcba06360", "b308592b001da5fd", "b308592b001da5fd"),
    "TGTAATC": ("b308592b001da5fd", "ef8d84dbcba06360", "b308592b001da5fd"),
}


def u64(x):
    return f"{x & (1 << 64) - 1:016x}"


def test_rolling_hash_goldens(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "kmer string")
    for r in df.select("kmer", hashing.forward_hash("kmer").alias("f"), hashing.reverse_hash("kmer").alias("r"), hashing.canonical_hash("kmer").alias("c")).collect():
        assert (u64(r.f), u64(r.r), u64(r.c)) == GOLDEN[r.kmer]


def test_rolled_and_whole_read_hashes_agree(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(200))
    for k in (1, 5, 31, 64, 70):
        rows = spark.createDataFrame([(seq[i : i + k],) for i in range(len(seq) - k + 1)], "kmer string")
        one = [r.h & (1 << 64) - 1 for r in rows.select(hashing.canonical_hash("kmer").alias("h")).collect()]
        assert one == hashing.read_hashes(seq.encode(), k).tolist()
    k = 6
    df = spark.createDataFrame([(seq[i : i + k], seq[i], seq[i + k], seq[i + 1 : i + k + 1]) for i in range(50)], "a string, o string, i string, b string")
    out = df.select(
        hashing.roll(hashing.forward_hash("a"), F.col("o"), F.col("i"), k).alias("f"), hashing.forward_hash("b").alias("f2"),
        hashing.roll_reverse(hashing.reverse_hash("a"), F.col("o"), F.col("i"), k).alias("r"), hashing.reverse_hash("b").alias("r2"),
    ).collect()
    assert all(x.f == x.f2 and x.r == x.r2 for x in out)


def test_checked_and_multi_hash(spark):
    df = spark.createDataFrame([("ACNGT",), ("ACGTA",), ("NNNNN",), ("ANGNT",)], "kmer string")
    got = [tuple(r.h) for r in df.select(hashing.checked_hash("kmer").alias("h")).collect()]
    assert [g[:2] for g in got] == [(False, 2), (True, 0), (False, 4), (False, 3)]
    base, second = df.filter("kmer = 'ACGTA'").select(hashing.multi_hash("kmer", 2).alias("h")).first().h
    x = ((base & (1 << 64) - 1) * (1 ^ (5 * hashing.MULTI_SEED & (1 << 64) - 1))) & (1 << 64) - 1
    assert second & (1 << 64) - 1 == x ^ x >> 27


def test_hash_table_equals_column_functions(spark):
    """Of k-mers of any lengths, null, empty and with other letters too."""
    rng = random.Random(11)
    odd = ["", "N", "acgtACGT", "ACNGTNA", "GéN", "ACé", "NNNNN"]
    seqs = odd + ["".join(rng.choice("ACGTNacgtn") for _ in range(n)) for n in range(1, 71)] + ["".join(rng.choice("ACGTN") for _ in range(11)) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "word string")
    plain = df.select("word", hashing.multi_hash("word", 4).alias("h"), hashing.checked_hash("word").alias("c")).select("word", "h", "c.*")
    got = hashing.hash_table(df.union(spark.createDataFrame([(None,)], "word string")).coalesce(1), 4, "word").collect()
    assert [tuple(r) for r in got if r.kmer is None] == [(None, [None] * 4, None, 0, None)]
    assert sorted((tuple(r) for r in got if r.kmer is not None), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_hash_multi_keeps_no_rows_beside_python(spark):
    """Rows that wait beside a Python column function took more than four times the input's size of disk."""
    plan = catalog.QUERIES["hash_multi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_murmur2_known_values():
    assert hashing.murmur2(b"") == 0
    assert hashing.murmur2(b"", 1) == 1540447798
    assert hashing.murmur2(b"\x01") == 0  # the length and the byte cancel
    assert len({hashing.murmur2(b"%d,%d,%d" % (i, i * i, i * 7)) for i in range(2000)}) == 2000


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN",), ("acgt",), ("",), ("AXC",), (None,)], "s string")
    got = [tuple(r) for r in df.select(dna.reverse_complement("s"), dna.is_palindrome("s"), dna.is_homopolymer("s"), dna.packed_bytes("s")).collect()]
    assert got[0] == ("NACGT", False, False, 2)
    assert got[1] == ("acgt", True, False, 1)
    assert got[3][0] is None and got[4] == (None, None, None, None)


def test_alignment_against_plain_dynamic_programme():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                d[i][j] = max(d[i + 1][j + 1] + (1 if a[i] == b[j] else -1), d[i + 1][j] - 1, d[i][j + 1] - 1)
        return max(0, *d[0], *[r[0] for r in d])

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(15))) for _ in range(2))
        assert J.align_score(a, b) == plain(a, b)


def test_ngx_is_null_when_not_reached(spark):
    df = spark.createDataFrame([(5,), (3,), (2,)], "len long")
    assert stats.ngx(df, 50, 10).first().ngx == 5
    assert stats.ngx(df, 50, 100).first().ngx is None
    s = stats.contig_summary(df, 100).first()
    assert (s.n_contigs, s.total, s.n50, s.ng50) == (3, 10, 5, 0)


def test_vector_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(stats.dot(F.col("a"), F.col("b")).alias("d"), stats.subtract_scalar(F.col("a"), 1.0).alias("s"), stats.add_vector(F.col("a"), F.col("b")).alias("v")).first()
    assert (r.d, r.s, r.v) == (11.0, [0.0, 1.0], [4.0, 6.0])
    assert np.isnan(spark.range(1).select(stats.jaccard_bits(F.lit(0), F.lit(0))).first()[0])
