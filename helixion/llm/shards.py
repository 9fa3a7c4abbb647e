"""Sharding by global byte-size prefix sums.

Rows are put in one global order, every partition reports its total, the
running sum of those few totals gives each partition its offset, and a row's
own offset decides its shard: cuts at equal byte targets, so shards are
contiguous in the order and differ by less than one row's size at each cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes that every row costs beside its text.
ROW_BYTES = 8
N_SHARDS = 24


def byte_shards(spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text).

    Order: doc_id (nulls first), then size and checksum, then input position;
    so tied and repeated ids are spread over partitions like any others. A null
    text counts no bytes and has the checksum of the empty text. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    grown_shard is null: byte balance moves cuts when shards are added.
    """
    scratch = Scratch(spark, "shards")
    sized = scratch.cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "sized",
    )
    ordered = scratch.cut(
        sized.repartitionByRange("doc_id", "size", "text_crc32", "at")
        .sortWithinPartitions("doc_id", "size", "text_crc32", "at")
        .withColumn("rank", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("rank", 33)),
        "ordered",
    )
    scratch.drop(sized)
    # One row a partition: this single-task window grows with partitions, not rows.
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("part").orderBy("rank")
    placed = ordered.select(
        "doc_id", "size", "text_crc32", "part",
        (F.sum("size").over(inside) - F.col("size")).alias("bytes_in"),
        (F.row_number().over(inside) - 1).cast("long").alias("row_in"),
    ).join(offsets, "part")
    placed = scratch.cut(
        placed.select(
            "doc_id", "size", "text_crc32",
            F.expr(f"least({n_shards - 1}, int((2 * (bytes_before + bytes_in) + size) * {n_shards} div (2 * total)))").alias("shard"),
            (F.col("rows_before") + F.col("row_in")).alias("at"),
        ),
        "placed",
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: DuckDB text: one running sum over all rows, and CRC-32 byte by byte from a table made of its polynomial.
ORACLE = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END) AS v FROM range(256) r(i))
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc
), s AS (
  SELECT *, (sum(size) OVER w - size)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total, row_number() OVER w AS place FROM d
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
), p AS (
  SELECT *, least({N_SHARDS - 1}, (2 * before + size) * {N_SHARDS} // (2 * total))::INT AS shard FROM s
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM p
"""
