"""The SimHash index by itself: its guarantee, its share of all leaks, and windows that many documents hold."""

import random

from pyspark.sql import functions as F

from helixion.llm import decontaminate as D
from helixion.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_blocks_meet_within_the_radius(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        f = rng.getrandbits(64)
        g = f
        for i in rng.sample(range(64), rng.randrange(D.RADIUS + 1)):
            g ^= 1 << i
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f, g)))
    df = spark.createDataFrame(rows, "f long, g long")
    met = df.select(F.arrays_overlap(D.lookups(F.col("f")), D.postings(F.col("g"))).alias("met"), D.first_near_block(F.col("f").bitwiseXOR(F.col("g"))).alias("b"))
    assert met.filter("NOT met OR b IS NULL").isEmpty()


def test_share_of_leaks_within_the_radius(spark):
    """Single-word edits, as benchmark texts are copied: at least nine in ten similar windows lie within the radius; all are found."""
    rng = random.Random(12)
    items = [(r.item_id, r.text.split()) for r in table(spark, SF, "benchmark").collect()]
    docs = []
    for k in range(300):
        w = list(rng.choice(items)[1])
        for _ in range(k % 3):
            p, o = rng.randrange(len(w)), rng.random()
            if o < 0.4:
                w[p] = "xx"
            elif o < 0.7:
                w.insert(p, "yy")
            else:
                del w[p]
        docs.append((k, " ".join([f"a{k}b{i}" for i in range(30)] + w + [f"c{k}d{i}" for i in range(30)])))
    got = D.find_leaks(spark, Scratch(spark, "t"), spark.createDataFrame(docs, "doc_id long, text string"), table(spark, SF, "benchmark")).collect()
    near = sum(r.distance <= D.RADIUS for r in got)
    assert near >= 0.9 * len(got) and len({r.doc_id for r in got}) >= 150


def test_one_passage_in_many_documents(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.col("id").cast("string"), F.lit(f" {item} end")).alias("text"))
    # Item 2 ends otherwise: the window one word earlier is as similar, and first.
    for c in ("h", "w", "c", "e", "item_id", "row", "m"):
        docs = docs.withColumn(c, F.lit(1))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item.replace("q29", "r29"))], "item_id long, text string")
    got = D.op9(spark, docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in got) == sorted((i, j, 2 if j == 1 else 1) for i in range(500) for j in (1, 2))


def test_long_text_and_null_ids(spark):
    item = [f"q{i}" for i in range(20)]
    rows = [(None, " ".join(["z"] * 100_000 + item)), (None, None), (3, "")]
    got = D.op9(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word) for r in got] == [(None, 1, 100_000)]
