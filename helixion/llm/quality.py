"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; policies are versioned sets of rules, so applying
another policy, or asking what a rule alone costs, is bit arithmetic over the
ledger and never reads the texts again. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, words

#: Words in a window whose repetition counts.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named failure condition, in SQL over the measurements."""

    name: str
    fails: str


#: Bit i of the ledger belongs to rule i; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("many_words", "n_words > 1000000"),
)

#: Policy versions; a policy is the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}
POLICY = "web-1"


def mask(policy: str, rules: tuple[Rule, ...] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[name] for name in policies[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements, one row per row of docs. Null text: all zero. Ids may repeat or be null.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only a
    document in which one repeats pays for sorting: equal hashes become
    neighbours in (hash, position) order, their positions are put in order, and
    each adds its words up to the next one's start. No row leaves its task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(F.col(text_col)).alias("_w"))
    a = a.select("doc_id", "_t", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # Lines with a word: the others have nothing left once spaces are dropped.
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    a = a.select(
        "doc_id", "n_words", "word_chars",
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.when(
            F.col("n_words") > WINDOW,
            F.transform(
                F.slice("_h", F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")),
                lambda h, i: F.xxhash64(h, *[F.get(F.col("_h"), i + k) for k in range(1, WINDOW)]),
            ),
        ).alias("_g"),
    )
    a = a.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "_g",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.size("_g") > F.size(F.array_distinct("_g"))).alias("_twice"),
    )
    # Each later array is its own column, so that it is computed once and only where a window repeats.
    a = a.withColumn("_p", F.when(F.col("_twice"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    a = a.withColumn(
        "_i",
        F.when(
            F.col("_twice"),
            F.array_sort(
                F.transform(
                    F.filter("_p", lambda x, j: (x["h"] == F.get("_p", j - 1)["h"]) | (x["h"] == F.get("_p", j + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(F.transform("_i", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_i", j + 1) - p, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    repeat = F.when(F.col("_twice"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")
    # One element exploded: filters on a measurement stay above it, else they would copy all of this into each condition.
    return a.select("doc_id", F.explode(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", repeat))).alias("_m")).select("doc_id", "_m.*")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **cols: str) -> DataFrame:
    """The measurements plus ``failures``: bit i set where rule i fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs, **cols).withColumn("failures", failures)


def apply_policy(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(led: DataFrame, policy: str = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that would be kept without it.

    The ledger is first counted by its distinct masks (at most 2^rules rows),
    so the hot mask of clean documents is pre-aggregated on the map side.
    """
    m = mask(policy, rules)
    by_mask = led.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    return (
        by_mask.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if m >> i & 1])))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("f") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )


def accept(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of docs that the policy keeps, unchanged."""
    rows = docs.select(F.col("text").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"))
    return apply_policy(ledger(rows), policy).filter("kept").select("doc_id.*")


def stored(scratch: Scratch, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger of docs, written once and reread: whatever policies or ablations follow never read the texts again."""
    return scratch.cut(ledger(docs, rules), "ledger")


def ablation_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_only, n_kept for the rules of every policy, from one stored ledger."""
    led = stored(Scratch(spark, "quality"), docs)
    parts = [ablations(led, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_only", "n_kept") for p in POLICIES]
    return reduce(DataFrame.unionByName, parts)


def op1(docs: DataFrame) -> DataFrame:
    """A row for every row of docs(doc_id, text): measurements, base verdict, policy verdict and the ledger's mask.

    Null and empty texts measure zero and fail ``few_words``. Ids may repeat or
    be null; repeated rows are measured each. A very long text is one row of one
    task, a few numbers a word. No rows, no result. Other columns are ignored,
    whatever their names. No rule has ties to break.
    """
    out = apply_policy(ledger(docs))
    base = F.lit(mask("base-1")).cast("long")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(base) != 0).alias("base_failed"), "kept", "n_lines", "failures", F.lit(POLICY).alias("policy"),
    )


#: DuckDB text of op1, by strings where the ledger compares hashes.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), c AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id
), f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_words > 1000000)::BIGINT) AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures & 63 = 0 AS kept, n_lines, failures, 'web-1' AS policy FROM f
"""

_OF = ", ".join(f"('{p}', '{r.name}', {1 << i}, {mask(p)})" for p, names in POLICIES.items() for i, r in enumerate(RULES) if r.name in names)
#: DuckDB text of the ablations.
ABLATION_ORACLE = f"""
WITH o AS ({ORACLE}), r(policy, rule, bit, mask) AS (VALUES {_OF})
SELECT r.policy, rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures & r.mask = bit) AS n_only, count(*) FILTER (failures & mask = 0) AS n_kept
FROM o, r GROUP BY r.policy, rule
"""
