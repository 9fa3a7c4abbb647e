"""The queries of this subpackage: name -> f(spark, sf_dir), and DuckDB text where SQL expresses one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, language, lines, mixing, quality, secrets, shards, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_ledger": lambda s, d: quality.op1(table(s, d, "documents")),
        "quality_ablations": lambda s, d: quality.ablation_query(s, table(s, d, "documents")),
        "op2_warc_chain": lambda s, d: warc.op2(s, table(s, d, "pages")),
        "op3_chat_format": lambda s, d: chat.op3(s, table(s, d, "conversations")),
        "op4_secret_novelty": lambda s, d: secrets.op4(table(s, d, "documents")),
        "op5_jaccard_join": lambda s, d: jaccard.similarity_components(s, table(s, d, "documents")),
        "op6_language_bayes": lambda s, d: language.op6(s, table(s, d, "documents")),
        "op7_temperature_mix": lambda s, d: mixing.op7(s, table(s, d, "documents")),
        "op8_line_windows": lambda s, d: lines.op8(s, table(s, d, "documents")),
        "op9_simhash_leaks": lambda s, d: decontaminate.op9(s, table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_byte_shards": lambda s, d: shards.byte_shards(s, table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """None for 4 and 6, which SQL can't express; tests hold them against plain Python."""
    return {
        "op1_quality_ledger": quality.ORACLE,
        "quality_ablations": quality.ABLATION_ORACLE,
        "op2_warc_chain": warc.ORACLE,
        "op3_chat_format": chat.ORACLE,
        "op5_jaccard_join": jaccard.ORACLE,
        "op7_temperature_mix": mixing.ORACLE,
        "op8_line_windows": lines.ORACLE,
        "op9_simhash_leaks": decontaminate.ORACLE,
        "op10_byte_shards": shards.ORACLE,
    }
