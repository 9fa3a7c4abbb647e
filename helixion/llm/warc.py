"""WARC archives: writing with deduplication, and reading by boundary-chain verification.

Reading is split-parallel. Every occurrence of the magic is a candidate record;
the task that sees it emits its offset and the successor offset that its
Content-Length claims. Only candidates reachable from offset 0 of their file
are records; magic inside a payload is never pointed at, so it drops out.
Candidates whose successor is simply the next candidate form runs; pointer
jumping goes over runs, so rounds grow with the logarithm of a file's anomalies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:page:"
#: Payloads below this many bytes are always stored.
MIN_REVISIT_BYTES = 100


def plan_revisits(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page stores: same bytes, smaller id."""
    d = pages.select("page_id", F.sha2("payload", 256).alias("digest")).filter(F.octet_length("payload") >= MIN_REVISIT_BYTES)
    first = d.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return scratch.cut(d.join(first, "digest").filter("page_id <> refers_to").distinct(), "revisits")


def write_archives(scratch: Scratch, pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> str:
    """One record a row of pages(page_id, url, html); returns the folder of .warc text files.

    Null html is an empty payload, a null url leaves its header out, line ends in
    a url are percent-encoded. Rows with a null id are stored, never revisits.
    Repeated rows of the storing id are each stored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    revisits = plan_revisits(scratch, rows)
    # A short list of revisits is broadcast by its written size, a long one is shuffled by page.
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    is_revisit = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(MAGIC),
        F.when(is_revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        F.lit(f"WARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(is_revisit, F.lit(0)).otherwise(F.octet_length("payload")).cast("string"), F.lit(BLANK),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    path = scratch.path("warc")
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", BLANK).text(path)
    scratch.drop(revisits)
    return path


def field(name: str):
    return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with its file, its split and its place in the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )


def with_offsets(df: DataFrame) -> DataFrame:
    """Adds the offset of the magic before each segment; what stands before the first magic has none and goes."""
    order = W.partitionBy("file").orderBy("block", "row")
    to_here = F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("at", to_here - len(MAGIC)).filter(F.col("at") >= 0)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of every file: offset, claimed successor, header fields, and the payload's digest where no magic cuts it."""
    s = segments(spark, path).select("file", "block", "row", "value", F.octet_length("value").alias("bytes"), F.when(F.contains("value", F.lit(BLANK)), F.substring_index("value", BLANK, 1)).alias("head"))
    s = s.withColumn("skip", (F.octet_length("head") + len(BLANK)).cast("int")).withColumn("length", F.expr("try_cast(regexp_extract(head, '(?:^|\\r\\n)Content-Length: *([0-9]+)', 1) AS int)"))
    whole = F.col("skip").cast("long") + F.col("length") <= F.col("bytes")
    s = s.select(
        "file", "block", "row", "bytes", "skip", "length",
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("uri"),
        field("WARC-Payload-Digest").alias("stated_digest"), field("WARC-Refers-To").alias("refers_to"),
        F.when(whole, F.sha2(F.expr("substring(cast(value AS binary), skip + 1, length)"), 256)).alias("digest"),
    )
    s = with_offsets(s)
    return s.withColumn("next", F.col("at") + len(MAGIC) + F.col("skip") + F.col("length").cast("long") + len(BLANK)).drop("block", "row")


def reachable(scratch: Scratch, found: DataFrame) -> DataFrame:
    """The rows of found(file, at, next, ...) on the chain that starts at offset 0 of their file."""
    order = W.partitionBy("file").orderBy("at")
    links = found.select("file", "at", "next", F.lead("at").over(order).alias("follower"), F.lag("next").over(order).alias("led_here"))
    odd = links.filter("next IS NOT NULL AND NOT next <=> follower").select("file", F.col("next").alias("at")).distinct().withColumn("aimed", F.lit(True))
    # A run starts where the candidate before doesn't lead here or one elsewhere does: runs are entered at their head only.
    runs = links.join(odd, ["file", "at"], "left").withColumn("head", F.when(F.col("aimed") | ~F.col("led_here").eqNullSafe(F.col("at")), F.col("at")))
    runs = runs.withColumn("head", F.last("head", ignorenulls=True).over(order))
    member = scratch.cut(runs.select("file", "at", "next", "head"), "runs")
    jump = member.groupBy("file", "head").agg(F.max_by("next", "at").alias("to"))
    jump = scratch.cut(jump, "jump")
    seen = scratch.cut(jump.filter("head = 0").select("file", "head"), "seen")
    n = seen.count()
    while n:
        more = scratch.cut(seen.union(seen.join(jump, ["file", "head"]).select("file", F.col("to").alias("head")).join(jump.select("file", "head"), ["file", "head"])).distinct(), "seen")
        m = more.count()
        scratch.drop(seen)
        seen = more
        if m == n:
            break
        n = m
        hop = jump.select("file", F.col("head").alias("to"), F.col("to").alias("further"))
        doubled = scratch.cut(jump.join(hop, ["file", "to"]).select("file", "head", F.col("further").alias("to")).union(jump.join(hop, ["file", "to"], "left_anti").select("file", "head", "to")), "jump")
        # The plain links stay among those that a round follows: R ∪ J(R) with J doubled covers every step.
        scratch.drop(jump)
        jump = doubled
    kept = member.join(seen, ["file", "head"], "left_semi").select("file", "at")
    return found.join(kept, ["file", "at"], "left_semi")


def cut_payloads(spark: SparkSession, path: str, records: DataFrame, cut: DataFrame) -> DataFrame:
    """file, at, payload of the records in ``cut``, joined again from the segments that magic inside them made."""
    own = segments(spark, path).join(cut.select("file").distinct(), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long"))
    own = with_offsets(own).join(records.select("file", "at", F.col("at").alias("start")), ["file", "at"], "left")
    own = own.withColumn("start", F.last("start", ignorenulls=True).over(W.partitionBy("file").orderBy("at")))
    keys = cut.select("file", F.col("at").alias("start"), "skip", "length")
    parts = own.join(keys, ["file", "start"]).groupBy("file", "start", "skip", "length").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["value"]), MAGIC)
    return parts.withColumn("joined", text.cast("binary")).select("file", F.col("start").alias("at"), F.expr("substring(joined, skip + 1, length)").alias("payload"))


def read_archives(spark: SparkSession, scratch: Scratch, path: str) -> DataFrame:
    """The records of all archives under path, with the digest of each one's own payload."""
    found = scratch.cut(candidates(spark, path), "candidates")
    records = scratch.cut(reachable(scratch, found), "records")
    scratch.drop(found)
    cut = records.filter("digest IS NULL AND length IS NOT NULL")
    if cut.isEmpty():
        return records
    mended = scratch.cut(cut_payloads(spark, path, records, cut).select("file", "at", F.sha2("payload", 256).alias("mended")), "mended")
    return records.join(mended, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "mended")).drop("mended")


def op2(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A revisit's bytes and digest are those of the record it refers to, as read."""
    scratch = Scratch(spark, "warc")
    path = write_archives(scratch, pages)
    records = read_archives(spark, scratch, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{URN}(-?[0-9]+)>', 1) AS bigint)")
    records = scratch.cut(
        records.select(number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), F.col("length").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "stated_digest"),
        "read",
    )
    scratch.delete(path)
    stored = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.concat(F.lit("sha256:"), "payload_digest").alias("stated_digest")).distinct()
    again = records.filter("record_type = 'revisit'").join(stored, ["refers_to", "stated_digest"])
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        records.filter("record_type = 'response'").select(*cols)
        .unionByName(again.select("page_id", F.col("b").alias("payload_bytes"), F.substring("stated_digest", 8, 64).alias("payload_digest"), "record_type", "refers_to"))
    )


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
