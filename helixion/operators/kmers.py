"""Reads to k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixion.functions import dna


def _windows(seq: Column, rc: Column, k: int) -> Column:
    """Array of canonical k-mers of an upper-case sequence: each window or, on the other strand, the matching window of the whole reverse complement.

    Binary substrings address bytes, so a window costs k steps however far in the read it lies.
    """
    b, r = seq.cast("binary"), rc.cast("binary")
    n = F.octet_length(seq)

    def one(i: Column) -> Column:
        return F.least(F.substring(b, i + 1, F.lit(k)), F.substring(r, n - k - i + 1, F.lit(k)))

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<binary>"))


def canonical_kmers(reads: DataFrame, k: int, seq: str = "seq", n_policy: str = "strict", canonical: bool = True) -> DataFrame:
    """One row ``kmer`` per window of each read. Reads shorter than k give none; null reads none.

    n_policy strict: windows with another letter than ACGT (any case) are left
    out. incoming: only an incoming upper-case N is noticed, so the first
    window after a restart may hold N.
    """
    if n_policy == "strict":
        pieces = F.filter(F.split(F.upper(F.col(seq)), "[^ACGT]+"), lambda x: F.length(x) >= k)
    elif n_policy == "incoming":
        pieces = incoming_n_stretches(F.col(seq), k)
    else:
        raise ValueError(n_policy)
    parts = reads.select(F.explode(pieces).alias("s"))
    if canonical:
        parts = parts.select(F.upper("s").alias("s")) if n_policy == "incoming" else parts
        parts = parts.select("s", F.reverse(F.translate("s", "ACGT", "TGCA")).alias("r"))
        return parts.select(F.explode(_windows(F.col("s"), F.col("r"), k)).alias("kmer")).select(F.col("kmer").cast("string").alias("kmer"))
    return parts.select(F.explode(forward_windows(F.col("s"), k)).alias("kmer"))


def forward_windows(seq: Column, k: int) -> Column:
    """Array of all windows of k letters, as they stand."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.substring(seq.cast("binary"), i + 1, F.lit(k)).cast("string"))).otherwise(F.array().cast("array<string>"))


def incoming_n_stretches(seq: Column, k: int) -> Column:
    """Array of the stretches whose windows the incoming-N rule keeps, in one pass over the read.

    A stretch begins at 0 and after each N that enters. Its first k letters are
    taken whole, N or not; the next N after them enters, ends it and is left
    out. A rest of fewer than k letters is none.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{{k}}}[^N]*+)N?"), F.lit(1))


def clean_runs(reads: DataFrame, k: int, seq: str = "seq", key: str = "read_id") -> DataFrame:
    """key, n, runs: number of windows of each read, and its windows without N as (pos, n, w), n the places up to the next of them. All within the row."""
    s = reads.select(key, F.upper(F.col(seq)).alias("s")).select(key, forward_windows(F.col("s"), k).alias("ws"))
    placed = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    s = s.select(key, F.size("ws").alias("n"), F.filter(placed, lambda x: ~F.contains(x["w"], F.lit("N"))).alias("c"))
    till = F.concat(F.slice(F.col("c")["pos"], F.lit(2), F.size("c")), F.array("n"))
    runs = F.zip_with("c", till, lambda x, e: F.struct(x["pos"].alias("pos"), (e - x["pos"]).alias("n"), x["w"].alias("w")))
    return s.select(key, "n", F.filter(runs, lambda x: x["w"].isNotNull()).alias("runs"))


def positioned_codes(reads: DataFrame, k: int, max_k: int = 31, seq: str = "seq", key: str = "read_id") -> DataFrame:
    """key, strand, pos, code: encoded forward k-mers by place, then those of the reverse complement from the end.

    A window with N repeats the last window without one before it, so every
    place has a value; places before the first clean window have none. Nothing
    is shuffled; rows that share a key are read each by itself.
    """
    if k > max_k:
        raise ValueError(f"k = {k} is not supported, at most {max_k}")
    w = clean_runs(reads, k, seq, key).select(key, F.col("n").alias("size"), F.inline("runs"))
    w = w.select(key, "size", dna.encode("w").alias("f"), dna.encode(dna.reverse_complement("w")).alias("r"), F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"))
    return w.select(key, F.inline(F.array(*[
        F.struct(F.lit(strand).alias("strand"), pos.alias("pos"), F.col(code).alias("code")) for strand, pos, code in (("+", F.col("pos"), "f"), ("-", F.col("size") - 1 - F.col("pos"), "r"))
    ])))


def mid_read_seeds(reads: DataFrame, k: int, rule: str = "center", seq: str = "seq") -> DataFrame:
    """kmer: one upper-case window per read from its middle; center starts at len/2 - k/2, half at len/2. None with N, none from short reads."""
    s = F.upper(F.col(seq))
    n = F.length(s)
    start = F.floor(n / 2) - (k // 2 if rule == "center" else 0)
    ok = (n >= k) & (start <= n - k) & (start >= 0)
    out = reads.filter(ok).select(s.substr((start + 1).cast("int"), F.lit(k)).alias("kmer"))
    return out.filter(~F.rlike("kmer", F.lit("[^ACGT]")))
