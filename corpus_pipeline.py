"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixion.llm import decontaminate, jaccard, mixing, quality, shards
from helixion.llm.common import Scratch, over, table

#: The mixture gives the most frequent source one whole pass and repeats none more than this.
MIX = mixing.Target(max_repetition=1.5, budget="cover")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy's rules accept."""
    return quality.accept(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return jaccard.keep_one(spark, docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of a benchmark item."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: once, or more for sources that it raises."""
    mixed = mixing.mixed(Scratch(spark, "mix"), docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"], docs["text"], docs["source"]), MIX)
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each row in the balanced shards."""
    return shards.byte_shards(spark, docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: DuckDB text of run()'s rows: each stage's text over the rows that the one before kept.
ORACLE_SQL = f"""
WITH stage1 AS MATERIALIZED (
  SELECT documents.* FROM documents JOIN ({quality.ORACLE}) q ON q.doc_id = documents.doc_id WHERE q.kept
), stage2 AS MATERIALIZED (
  SELECT s.* FROM stage1 s JOIN ({over(jaccard.ORACLE, "documents", "SELECT * FROM stage1")}) c ON c.doc_id = s.doc_id WHERE c.component_id = s.doc_id
), stage3 AS MATERIALIZED (
  SELECT * FROM stage2 WHERE doc_id NOT IN (SELECT doc_id FROM ({over(decontaminate.ORACLE, "documents", "SELECT * FROM stage2")}))
), stage4 AS MATERIALIZED (
  SELECT s.* FROM stage3 s JOIN ({over(mixing.oracle(MIX), "documents", "SELECT * FROM stage3")}) m ON m.doc_id = s.doc_id
)
SELECT * FROM ({over(shards.ORACLE, "documents", "SELECT * FROM stage4")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null and very short texts fail the quality rules. Of rows that repeat id and
    text one stays; rows with a null id are judged like others, and near copies
    that have only null ids all stay. Very long texts are read whole. Columns
    beside those of documents are carried along to the last stage. An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage{i + 1}")
            scratch.release()
    return docs
