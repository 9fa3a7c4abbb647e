"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised. Alpha is
bisected (on a grid, so that few passes over the source table are needed) until
the mixture has a target entropy or no source repeats more than allowed. Each
source then gets whole passes and a part of one more. Each pass has its own
permutation: documents are ordered by a hash of their draw and the pass, and
dealt into blocks of about BLOCK documents; the last pass is taken block by
block until the budget is spent. Only per-source cut points go back to the
documents, so texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, beside, words

BLOCK = 4096
GRID, ROUNDS = 32, 6


@dataclass(frozen=True)
class Target:
    """One of: entropy, as a share of the largest possible; max_repetition of any source.

    budget: tokens of the mixture, None for as many as the input has, or "cover"
    for as many as give the most frequent source one whole pass.
    """

    entropy: float | None = None
    max_repetition: float | None = None
    budget: int | str | None = None


def source_key(source: Column) -> Column:
    """Null sources are one source of their own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_table(items: DataFrame) -> DataFrame:
    """_s, tokens, docs by source, from rows (_s, tokens); hot sources are summed before the shuffle."""
    return items.groupBy("_s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def solve(sources: DataFrame, target: Target) -> tuple[float, float, int]:
    """(alpha, normaliser, budget). Smallest repetition or entropy error is met from the safe side.

    entropy: the largest alpha in [0, 1] whose entropy reaches the target.
    max_repetition: the smallest alpha whose most repeated source keeps the limit;
    where even alpha = 1 exceeds it (a large budget), 1.
    """
    spoken = sources.filter("tokens > 0")
    total, most, n = spoken.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()
    if not n:
        return 1.0, 1.0, 0
    p = F.col("tokens") / F.lit(float(total))
    cover = target.budget == "cover"
    budget = None if cover else int(target.budget or total)

    def at(alphas: list[float]):
        grid = spoken.select(p.alias("p"), F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("a"))
        rows = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("l"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("r")).collect()
        return sorted((r["a"], r["z"], r["l"], r["r"]) for r in rows)

    import math

    lo, hi, norm = 0.0, 1.0, 1.0
    for _ in range(ROUNDS):
        rows = at(sorted({lo + (hi - lo) * i / GRID for i in range(GRID + 1)}))
        good = []
        for a, z, log_sum, r in rows:
            tokens = most * z / (most / total) ** a if cover else budget
            if target.entropy is not None:
                good.append(math.log(z) - a * log_sum / z >= target.entropy * math.log(n) - 1e-12)
            else:
                good.append(r / z * tokens / total <= (target.max_repetition or 1.0) + 1e-12)
        if target.entropy is not None:  # true, then false
            i = max([k for k, g in enumerate(good) if g], default=0)
            lo, hi, pick = rows[i][0], rows[min(i + 1, len(rows) - 1)][0], rows[i]
        else:  # false, then true
            i = min([k for k, g in enumerate(good) if g], default=len(rows) - 1)
            lo, hi, pick = rows[max(i - 1, 0)][0], rows[i][0], rows[i]
        alpha, norm = pick[0], pick[1]
        if hi - lo <= 1e-9:
            break
    if cover:
        budget = int(most * norm / (most / total) ** alpha)
    return alpha, norm, budget


#: Bits of a draw.
DRAW = 60


def _number(text: Column) -> Column:
    """The first DRAW bits of a text's MD5, as a number."""
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(DRAW // 4)), 16, 10).cast("long")


def draw(key: Column, text: Column, seed: int) -> Column:
    """A document's draw, from which its place in each pass follows. Rows that repeat id and text share it."""
    return _number(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def in_pass(u: Column, n: Column) -> Column:
    """The key by which pass n orders documents with draw u."""
    return _number(F.concat(u.cast("string"), F.lit(":"), n.cast("string")))


def block_of(v: Column) -> Column:
    """The block of a pass that a key falls in, by the source's ``bits``."""
    return F.call_function("shiftright", v, F.lit(DRAW) - F.col("bits")).cast("long")


def drawn_items(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """_s, tokens, u, and more columns of docs(doc_id, source, text)."""
    return docs.select(source_key(docs["source"]).alias("_s"), F.size(words(docs["text"])).cast("long").alias("tokens"), draw(docs["doc_id"], docs["text"], seed).alias("u"), *more)


def mix_plan(scratch: Scratch, items: DataFrame, target: Target) -> DataFrame:
    """_s, weight, bits, passes, last: whole passes of each source, and the key up to which one more is taken (null: none).

    items: _s, tokens, u of every document, as a written table.
    """
    sources = scratch.cut(source_table(items), "sources")
    alpha, norm, budget = solve(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(alpha)) / F.lit(norm)
    want = F.floor(share * F.lit(float(budget)) + F.lit(1e-6)).cast("long")
    if target.budget == "cover":  # a whole pass of each source, however its share was rounded
        want = F.greatest(want, F.col("tokens"))
    plan = sources.select(
        "_s", share.alias("weight"), "tokens",
        F.when(F.col("tokens") > 0, want).otherwise(0).alias("want"),
        F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.log2(F.col("docs") / BLOCK)))).cast("int").alias("bits"),
    )
    # A source without a word has nothing to weigh: its documents stay as they are, once.
    plan = plan.select("_s", "weight", "bits", F.expr("if(tokens > 0, want div greatest(tokens, 1), 1)").alias("passes"), F.expr("if(tokens > 0, want % greatest(tokens, 1), 0)").alias("rest"))
    plan = scratch.cut(plan, "plan")
    dealt = items.select("_s", "u", "tokens").join(plan, "_s").select("_s", in_pass(F.col("u"), F.col("passes")).alias("v"), "tokens", "rest", "bits")
    dealt = dealt.withColumn("block", block_of(F.col("v")))
    totals = dealt.groupBy("_s", "block", "rest").agg(F.sum("tokens").alias("t"))  # a hot source is many blocks
    run = W.partitionBy("_s").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("t").over(run))
    cut = totals.filter("upto > rest AND upto - t <= rest").groupBy("_s").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")), "block").alias("c")).select("_s", "c.*")
    inside = W.partitionBy("_s", "block").orderBy("v").rangeBetween(W.unboundedPreceding, 0)
    taken = dealt.join(cut, ["_s", "block"]).withColumn("upto", F.sum("tokens").over(inside)).filter("upto <= room")
    last = taken.groupBy("_s").agg(F.max("v").alias("last"))
    edge = cut.join(plan.select("_s", "bits"), "_s").select("_s", F.expr(f"shiftleft(block, {DRAW} - bits)").alias("floor"))
    out = plan.join(edge, "_s", "left").join(last, "_s", "left")
    # Everything below the cut block, and of that block what fits; no cut block: the rest is a whole pass or nothing.
    return scratch.cut(out.select("_s", "weight", "bits", "passes", F.when(F.col("rest") == 0, F.lit(None)).otherwise(F.coalesce("last", F.col("floor") - 1)).alias("last")), "cuts")


def times(u: Column) -> Column:
    """How often a document with draw u is taken, beside its source's plan."""
    more = in_pass(u, F.col("passes")) <= F.col("last")
    return F.col("passes") + F.coalesce(more.cast("long"), F.lit(0))


def mixed(scratch: Scratch, docs: DataFrame, target: Target, seed: int = 17, copies: str = "copies", weight: str = "weight") -> DataFrame:
    """docs with two columns added: how often the mixture takes each row (0: not at all), and its source's weight.

    Null sources are a source; null texts have no tokens and go with whole
    passes; an empty table stays empty. Rows repeating id and text fare alike,
    as do a null and an empty text. A very long text counts whole. Columns of
    docs that have the name of an added one are replaced by it.
    """
    items = scratch.cut(drawn_items(docs, seed), "items")
    plan = mix_plan(scratch, items, target)
    scratch.drop(items)
    d = docs.select(F.struct(*beside(docs, copies, weight)).alias("_row"), source_key(docs["source"]).alias("_s"), draw(docs["doc_id"], docs["text"], seed).alias("_u"))
    # As long as the written plan is small Spark broadcasts it; many sources are joined by shuffle, hot ones split.
    out = d.join(plan, "_s").select("_row", times(F.col("_u")).alias("_copies"), F.col("weight").alias("_weight"))
    return out.select("_row.*", F.col("_copies").alias(copies), F.col("_weight").alias(weight))


def realised(scratch: Scratch, docs: DataFrame, target: Target, seed: int = 17) -> DataFrame:
    """doc_id, source, weight, pass, block, place: a row for each time that the mixture takes a document.

    A reader of the mixture takes the blocks of a pass one by one, in any order
    and beside those of other sources; place is a document's rank in its block
    (ties, which only rows repeating id and text are, share it). A block holds
    about BLOCK documents, so no window spans more, however large a source.
    """
    items = scratch.cut(drawn_items(docs, seed, docs["doc_id"], docs["source"]), "items")
    plan = mix_plan(scratch, items, target)
    rows = items.join(plan, "_s").withColumn("copies", times(F.col("u"))).filter("copies > 0")
    rows = rows.select("doc_id", "source", "weight", "_s", "u", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("pass"))
    rows = rows.withColumn("v", in_pass(F.col("u"), F.col("pass"))).withColumn("block", block_of(F.col("v")))
    place = F.rank().over(W.partitionBy("_s", "pass", "block").orderBy("v")) - 1
    return rows.select("doc_id", "source", "weight", "pass", "block", place.cast("long").alias("place"))


#: Production parameters of the query: as many tokens as the input has, nothing more than twice.
QUERY = Target(max_repetition=2.0)


def op7(spark, documents: DataFrame) -> DataFrame:
    """The mixture, a row for each time it takes a document: doc_id, source, weight (to 9 digits), pass, block, place."""
    out = realised(Scratch(spark, "mix"), documents.select("doc_id", "source", "text"), QUERY)
    return out.withColumn("weight", F.round("weight", 9))


def _bisected(target: Target) -> str:
    """The rounds of the search for the exponent, each on the grid that the one before it left."""
    tokens = "max(m) * sum(pow(p, a)) / pow(max(m) / max(total), a)" if target.budget == "cover" else "max(total)"
    out = ["r0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"]
    for k in range(1, ROUNDS + 1):
        out.append(
            f"e{k} AS (SELECT a, max(pow(p, a - 1)) / sum(pow(p, a)) * ({tokens}) / max(total) <= {target.max_repetition} + 1e-12 AS good FROM (SELECT lo + (hi - lo) * i / {GRID} AS a FROM r{k - 1}, range({GRID + 1}) g(i)), p GROUP BY a), "
            f"h{k} AS (SELECT coalesce(min(a) FILTER (good), max(a)) AS hi FROM e{k}), "
            f"r{k} AS (SELECT coalesce(max(a) FILTER (a < hi), any_value(hi)) AS lo, any_value(hi) AS hi FROM e{k}, h{k})"
        )
    return ", ".join(out)


def oracle(target: Target) -> str:
    """DuckDB text for a repetition limit: the same grid for the exponent, and a running sum over each source's last pass."""
    cover = target.budget == "cover"
    budget = "floor(most * norm / pow(most / total, alpha))" if cover else "total"
    want = f"floor(pow(tokens / total, alpha) / norm * {budget} + 1e-6)::BIGINT"
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens,
    ('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15))::BIGINT AS u FROM documents
), src AS (
  SELECT s, sum(tokens)::BIGINT AS tokens, count(*) AS docs, (sum(sum(tokens)) OVER ())::DOUBLE AS total FROM d GROUP BY s
), p AS (SELECT tokens / total AS p, max(tokens) OVER () AS m, total FROM src WHERE tokens > 0), {_bisected(target)},
z AS (SELECT hi AS alpha, sum(pow(p, hi)) AS norm, max(m) AS most FROM r{ROUNDS}, p GROUP BY hi),
plan AS (
  SELECT s, weight, bits, CASE WHEN tokens > 0 THEN want // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN want % tokens ELSE 0 END AS rest
  FROM (SELECT s, tokens, pow(tokens / total, alpha) / norm AS weight, {f"greatest({want}, tokens)" if cover else want} AS want,
    least(40, greatest(1, ceil(log2(docs / {BLOCK}))))::INT AS bits FROM src, z)
), t AS (
  SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY v RANGE UNBOUNDED PRECEDING) <= rest AND rest > 0 AS more
  FROM (SELECT d.*, plan.* EXCLUDE (s), ('0x' || left(md5(u || ':' || passes), 15))::BIGINT AS v FROM d JOIN plan ON d.s = plan.s)
), x AS (
  SELECT doc_id, source, weight, s, bits, pass, ('0x' || left(md5(u || ':' || pass), 15))::BIGINT AS v
  FROM (SELECT *, unnest(range(0, passes + more::BIGINT)) AS pass FROM t)
)
SELECT doc_id, source, round(weight, 9) AS weight, pass, v >> ({DRAW} - bits) AS block, rank() OVER (PARTITION BY s, pass, v >> ({DRAW} - bits) ORDER BY v) - 1 AS place FROM x
"""


ORACLE = oracle(QUERY)
