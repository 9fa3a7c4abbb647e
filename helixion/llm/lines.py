"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are hashed. A window that occurs
elsewhere before (by document, then position) is removed: its lines are marked,
overlapping marks merge, and the unmarked lines stay. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, touched

LINES = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is known by id and text: rows that repeat both are one document and are treated alike."""
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_t": F.xxhash64("text"), "_lines": F.split("text", "\n")})


def repeated_positions(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """_k, _t, marked: line numbers (from 0) covered by windows that aren't the first of their text."""
    ls = F.col("_lines")
    at = F.when(F.size(ls) >= LINES, F.sequence(F.lit(0), F.size(ls) - LINES)).otherwise(F.array().cast("array<int>"))
    spoken = lambda i: F.rlike(F.concat(*[F.get(ls, i + j) for j in range(LINES)]), F.lit(r"[^\x20\x09-\x0D]"))  # noqa: E731  blank windows are no text
    windows = F.transform(F.filter(at, spoken), lambda i: F.struct(F.xxhash64(*[F.get(ls, i + j) for j in range(LINES)]).alias("h"), i.alias("i")))
    seen = scratch.cut(docs.select("_k", "_t", F.explode(windows).alias("w")).select("_k", "_t", "w.h", "w.i"), "windows")
    # One row a repeated window, pre-aggregated before the shuffle; the join back splits hot ones at run time.
    first = seen.groupBy("h").agg(F.min(F.struct("_k", "_t", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    later = seen.join(first, "h").filter(F.struct("_k", "_t", "i") != F.col("first"))
    marked = later.groupBy("_k", "_t").agg(F.collect_set("i").alias("s"))
    cover = F.array_distinct(F.flatten(F.transform("s", lambda i: F.sequence(i, i + LINES - 1))))
    return scratch.cut(marked.select("_k", "_t", cover.alias("marked")), "marked")


def dedup_lines(scratch: Scratch, docs: DataFrame, name: str = "clean") -> DataFrame:
    """docs with ``clean`` (the text without repeats), ``n_lines`` and ``n_removed`` added.

    Null texts stay null, with no lines. Texts under three lines have no window
    and stay. Windows without a word never repeat. Ties are impossible: the
    first is by id (null first), text hash and position; rows that repeat id and
    text are one document and fare alike. A very long text is one row of one
    task. An empty table stays empty. Columns of docs that have the name of an
    added one are replaced by it.
    """
    added = (name, "n_lines", "n_removed")
    keyed = _keyed(docs.select(F.struct(*beside(docs, *added)).alias("_row"), docs["doc_id"], docs["text"]))
    marks = repeated_positions(scratch, keyed)
    key = F.xxhash64("_k", "_t")
    may, clear = touched(scratch, keyed.drop("_lines"), key, marks.select(key.alias("m")))
    # Only texts with a mark, and few others, are shuffled; without the arrays made of them.
    may = may.join(marks, ["_k", "_t"], "left").withColumn("_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("marked", F.array().cast("array<int>")))
    kept = F.when(F.col("marked").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))

    def told(rows: DataFrame, text: Column, removed: Column) -> DataFrame:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
        return rows.select("_row.*", text.alias(added[0]), n.alias(added[1]), removed.cast("long").alias(added[2]))

    return told(clear, F.col("text"), F.lit(0)).unionByName(told(may, kept, F.coalesce(F.size("marked"), F.lit(0))))


def op8(spark, documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_md5 (null for a null text) of every row."""
    out = dedup_lines(Scratch(spark, "lines"), documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS win FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
), r AS (
  SELECT doc_id, i FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), m AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r
), x AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l
), k AS (
  SELECT x.doc_id, count(*)::BIGINT AS n_lines, count(m.i)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (m.i IS NULL), '') AS clean
  FROM x LEFT JOIN m ON x.doc_id = m.doc_id AND x.i = m.i GROUP BY x.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(clean) AS clean_md5 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
