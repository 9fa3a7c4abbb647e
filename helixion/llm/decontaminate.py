"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

For each item of w words, windows of w words of a document are fingerprinted
with a 64-bit SimHash of their words. A document of fewer words, but a shingle
at least, is one window: its whole text. Fingerprints are cut into BLOCKS blocks
of 16 bits; if two differ in at most RADIUS bits, some block differs in at most
NEAR (pigeonhole). So items are indexed under every value within NEAR bits of
each of their blocks, windows look up their blocks as they are, and an equality
join on (w, block number, value) finds every pair within the radius. Windows of
equal words are one window here, however many documents hold them. Similar texts
can lie beyond the radius, so windows and items are also joined by shingles: of
a window's k shingle places, need() at least are shared, so any k - need() + 1
places hold a shingle of the item. Candidates are verified by their weighted
5-word shingles: sum of the smaller over sum of the larger multiplicities, 0.75
or more.

Windows that can't reach that similarity are left out before fingerprinting,
which loses nothing: a window similar enough to an item of w words has at least
3/7 of the shingle places of both together (6/7 of its own, where it has w words)
filled with shingles of items that long.
A bit table of fixed size (a Bloom filter with two probes over the items'
shingles) lets a document's places be tested in its own row, so texts of clean
documents are neither exploded nor shuffled. Built-in expressions only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIN_SIMILARITY_PERCENT, SHINGLE_WORDS, Scratch, bit_table, in_bits, touched, words

BITS = 64
BLOCKS, NEAR = 4, 3
WIDTH = BITS // BLOCKS
RADIUS = BLOCKS * (NEAR + 1) - 1


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def shingle_hashes(h: Column) -> Column:
    """Hash of each SHINGLE_WORDS consecutive words; texts with fewer have none."""
    n = F.size(h) - SHINGLE_WORDS + 1
    first = F.when(n > 0, F.slice(h, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE_WORDS)]))


def simhash(h: Column) -> Column:
    """64-bit SimHash of an array of word hashes; every occurrence weighs one. A bit is set by more than half of the words."""
    half = F.size(h)
    vote = lambda b: F.aggregate(h, F.lit(0), lambda acc, x: acc + F.call_function("getbit", x, b).cast("int"))
    bit = lambda b: F.when(vote(b) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(h: Column) -> list[Column]:
    """The values of a fingerprint's blocks."""
    return [F.shiftrightunsigned(h, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)) for i in range(BLOCKS)]


def lookups(h: Column) -> Column:
    """(number, value) of each block."""
    return F.array(*[F.struct(F.lit(i).alias("b"), v.alias("v")) for i, v in enumerate(blocks(h))])


def postings(h: Column) -> Column:
    """(number, value) for all values within NEAR bits of each block."""
    flips = [sum(1 << i for i in c) for k in range(NEAR + 1) for c in itertools.combinations(range(WIDTH), k)]
    flips = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")  # a constant of few nodes

    def around(i: int, value: Column) -> Column:
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("b"), value.bitwiseXOR(x).alias("v")))

    return F.flatten(F.array(*[around(i, v) for i, v in enumerate(blocks(h))]))


def first_near_block(x: Column) -> Column:
    """Number of the first block in which a difference of fingerprints has at most NEAR bits."""
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(blocks(x)))):
        out = F.when(F.bit_count(v) <= NEAR, i).otherwise(out)
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """(sum of smaller, sum of larger) multiplicities over all shingles of two arrays."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return F.struct(both.alias("low"), (F.size(a) + F.size(b) - both).alias("high"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, w, h, s of the items that have a shingle; null and shorter texts can't leak by this measure."""
    out = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("h")).select("item_id", F.size("h").alias("w"), "h")
    return out.filter(F.col("w") >= SHINGLE_WORDS).withColumn("s", shingle_hashes(F.col("h")))


def need(n: Column, w: Column) -> Column:
    """Least shingle places of a window of n words that must be shingles of items of w words: the overlap of these sizes at the threshold."""
    k, p = n + w - 2 * (SHINGLE_WORDS - 1), MIN_SIMILARITY_PERCENT
    return F.ceil(F.lit(p) * k / (100 + p) - F.lit(1e-9)).cast("int")


def leads(s: Column, least: Column) -> Column:
    """The distinct shingles of the first places of a window, one of which any item with ``least`` places in common has."""
    return F.array_distinct(F.slice(s, F.lit(1), F.greatest(F.size(s) - least + 1, F.lit(1))))


def find_leaks(spark: SparkSession, scratch: Scratch, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, distance, low, high: windows of documents that are near copies of an item.

    One row per (doc_id, item_id): the most similar window, then the first. A
    document shorter than an item is compared with it as a whole.
    start counts words from 0. Texts are lower-cased. Null texts, texts and items
    without a shingle, an empty table and an empty benchmark give no rows;
    documents sharing an id are examined each and reported under the id; a null
    id is reported as null. Items that repeat an id are one item, the most
    similar text of which stands. A very long text is searched whole, in one
    row. Other columns are ignored, whatever their names.
    """
    items = scratch.cut(items_of(benchmark).select("item_id", "w", "s", simhash(F.col("h")).alias("g")), "items")
    places = items.select("w", F.explode("s").alias("s")).distinct()
    table = scratch.cut(bit_table(places.select("s").distinct(), F.col("s")), "table")
    bits = table.scalar()
    d = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), word_hashes(F.col("text")).alias("h"))
    d = d.select("doc_id", "row", "h", shingle_hashes(F.col("h")).alias("s"), bits.alias("bits"))

    d = d.select("doc_id", "row", "h", "s", F.filter(F.transform("s", lambda x, i: F.when(in_bits(F.col("bits"), x), i)), lambda i: i.isNotNull()).alias("p"))
    # Exploded as one element: later filters can't copy the expressions above into themselves.
    d = d.select(F.explode(F.when(F.size("p") > 0, F.array(F.struct("doc_id", "row", "h", F.transform("p", lambda i: F.struct(i.alias("i"), F.get("s", i).alias("s"))).alias("p")))).otherwise(F.expr("array()"))).alias("x"))
    found = scratch.cut(d.select("x.*"), "seeded")
    # Exact from here on: places of shingles that items of w words have.
    seeds = found.select("row", F.size("h").alias("n"), F.explode("p").alias("p")).select("row", "n", "p.i", "p.s").join(places, "s")
    runs = seeds.groupBy("row", "n", "w").agg(F.sort_array(F.collect_list("i")).alias("p"))
    last = F.col("w") - SHINGLE_WORDS  # of a window starting at 0

    def starts(i: Column, j: Column) -> Column:
        """Starts of the windows whose first place filled is number j, at i, and that have enough of them."""
        end = F.get("p", j + F.col("need") - 1)
        low = F.greatest(F.coalesce(F.get("p", j - 1) + 1, F.lit(0)), end - last, F.lit(0))
        return F.when(end.isNotNull() & (low <= i), F.sequence(low, i)).otherwise(F.array().cast("array<int>"))

    whole = F.when(F.size("p") >= F.col("need"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    runs = runs.withColumn("need", need(F.least("n", "w"), F.col("w")))
    windows = runs.select("row", "n", "w", F.explode(F.when(F.col("n") < F.col("w"), whole).otherwise(F.flatten(F.transform("p", starts)))).alias("start"))
    # A slice of a shorter text is all of it. c, e: two hashes that name a window's words.
    windows = windows.filter("start = 0 OR start + w <= n").join(found.select("row", "doc_id", "h"), "row").withColumn("h", F.slice("h", F.col("start") + 1, F.col("w")))
    windows = scratch.cut(windows.select("doc_id", "w", "start", "h", F.xxhash64("h").alias("c"), F.xxhash64(F.lit(1), F.col("h")).alias("e")), "windows")
    scratch.drop(found)
    # Few bytes, much work: dealt out by number, where sizes alone would make few tasks.
    each = windows.groupBy("w", "c", "e").agg(F.first("h").alias("h")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c", "e")
    each = scratch.cut(each.select("w", "c", "e", "h", simhash(F.col("h")).alias("f")), "fingerprints")
    left = each.select("w", "c", "e", "f", F.explode(lookups(F.col("f"))).alias("k")).select("w", "c", "e", "f", "k.b", "k.v")
    right = items.select("item_id", "w", "g", F.explode(postings(F.col("g"))).alias("k")).select("item_id", "w", "g", "k.b", "k.v")
    differ = F.col("f").bitwiseXOR(F.col("g"))
    near = left.join(right, ["w", "b", "v"]).withColumn("x", differ).withColumn("distance", F.bit_count("x").cast("int"))
    # A pair that is near in several blocks is kept where it first is.
    near = near.filter((F.col("distance") <= RADIUS) & (F.col("b") == first_near_block(F.col("x")))).select("w", "c", "e", "item_id", "distance")
    far_left = each.withColumn("lead", leads(shingle_hashes(F.col("h")), need(F.size("h"), F.col("w")))).select("w", "c", "e", "f", "lead", F.explode("lead").alias("v"))
    far_right = items.select("item_id", "w", "g", "s", F.explode(F.array_distinct("s")).alias("v"))
    far = far_left.join(far_right, ["w", "v"]).withColumn("distance", F.bit_count(differ).cast("int")).filter(F.col("distance") > RADIUS)
    # Here too, by the first leading shingle that the item has.
    first = F.get(F.filter("lead", lambda x: F.array_contains("s", x)), F.lit(0))
    far = far.filter(F.col("v") == first).select("w", "c", "e", "item_id", "distance")
    met = near.unionByName(far).join(each.select("w", "c", "e", "h"), ["w", "c", "e"]).join(items.select("item_id", "w", "s"), ["item_id", "w"])
    met = met.select("w", "c", "e", "item_id", "distance", weighted_similarity(shingle_hashes(F.col("h")), F.col("s")).alias("m"))
    # One element exploded: the filter stays above the measure, else it would be computed in each condition.
    met = met.select("w", "c", "e", F.explode(F.array(F.struct("item_id", "distance", F.col("m.low").alias("low"), F.col("m.high").alias("high")))).alias("m"))
    alike = met.filter(f"100 * m.low >= {MIN_SIMILARITY_PERCENT} * m.high")
    leaks = windows.select("doc_id", "w", "start", "c", "e").join(alike, ["w", "c", "e"]).select("doc_id", F.col("m.item_id").alias("item_id"), F.struct("m.low", "m.high", "start", "m.distance").alias("m"))
    best = leaks.groupBy("doc_id", "item_id").agg(F.min_by("m", F.struct((-F.col("m.low") / F.col("m.high")).alias("a"), F.col("m.start").alias("b"), F.col("m.high").alias("c"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").cast("long").alias("start"), F.col("m.low").cast("long").alias("low"), F.col("m.high").cast("long").alias("high"), F.col("m.distance").alias("distance"))


def op9(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    leaks = find_leaks(spark, Scratch(spark, "leaks"), documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return leaks.select("doc_id", "item_id", F.col("start").alias("start_word"), F.col("low").alias("shared_weight"), F.col("high").alias("total_weight"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leaked item, unchanged. Rows that share an id with a leaking one go with it; null texts stay."""
    scratch = Scratch(spark, "clean")
    leaks = scratch.cut(find_leaks(spark, scratch, docs.select("doc_id", "text"), benchmark.select("item_id", "text")).select("doc_id").distinct(), "ids")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"))
    may, clear = touched(scratch, rows, F.col("_id"), leaks)
    return clear.select("_row.*").unionByName(may.join(leaks, F.col("_id").eqNullSafe(F.col("doc_id")), "left_anti").select("_row.*"))


#: DuckDB text: every alignment of an item with a document by a shared shingle, without fingerprints.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), bs AS (
  SELECT item_id, n, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, len(w) AS n, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), seed AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, bs.n, ds.i - off AS start
  FROM ds JOIN bs USING (s), (SELECT unnest(range(0, 60)) AS off) WHERE off <= bs.n - 5 AND ds.i - off >= 1
), win AS (
  SELECT seed.doc_id, item_id, start, n, n AS k, d.w AS w FROM seed JOIN d ON seed.doc_id = d.doc_id WHERE start + n - 1 <= len(d.w)
  UNION ALL SELECT DISTINCT ds.doc_id, bs.item_id, 1, n, len(d.w), d.w FROM ds JOIN bs USING (s) JOIN d ON ds.doc_id = d.doc_id WHERE len(d.w) < n
), ws AS (
  SELECT doc_id, item_id, start, n, k, s, count(*) AS c
  FROM (SELECT doc_id, item_id, start, n, k, array_to_string(w[j:j + 4], ' ') AS s FROM (SELECT *, unnest(range(start, start + k - 4)) AS j FROM win)) GROUP BY ALL
), bc AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL
), m AS (
  SELECT ws.doc_id, ws.item_id, ws.start, ws.n, ws.k, sum(least(ws.c, bc.c)) AS low FROM ws JOIN bc USING (item_id, s) GROUP BY ALL
), ok AS (
  SELECT doc_id, item_id, start - 1 AS start_word, low AS shared_weight, n + k - 8 - low AS total_weight FROM m WHERE 100 * low >= 75 * (n + k - 8 - low)
)
SELECT doc_id, item_id, start_word, shared_weight::BIGINT AS shared_weight, total_weight::BIGINT AS total_weight FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared_weight / total_weight DESC, start_word) = 1
"""
