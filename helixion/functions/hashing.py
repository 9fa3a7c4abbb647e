"""Rolling hashes of k-mers, and MurmurHash2.

The hash of a k-mer is the exclusive or of its bases' seeds, each rotated by
its distance from the end; the reverse strand's is that of the complements,
rotated by their distance from the start. The canonical hash is the unsigned
lesser one. Single k-mers are hashed by expressions, large tables of them by an
Arrow function, whole reads by one over prefix folds, constant work a k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .dna import col

#: Seeds by base.
SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
#: Multiplier and shift of the further hashes of a k-mer.
MULTI_SEED, MULTI_SHIFT = 0x90B45D39FB6DA1FA, 27
MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rotl(x: Column, n: Column | int) -> Column:
    """Rotation of a BIGINT to the left. Shifts take their count modulo 64, so a rotation by 0 is itself."""
    n = n if isinstance(n, Column) else F.lit(n)
    left = F.call_function("shiftleft", x, n.cast("int"))
    right = F.call_function("shiftrightunsigned", x, ((F.lit(64) - n) % 64).cast("int"))
    return F.when(n % 64 == 0, x).otherwise(left.bitwiseOR(right))


def rotr(x: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return rotl(x, (F.lit(64) - n % 64) % 64)


def _seed(base: Column, complement: bool = False) -> Column:
    pairs = {"A": "T", "C": "G", "G": "C", "T": "A"}
    b = F.upper(base)
    out = F.lit(0).cast("long")
    for x in "TGCA":
        out = F.when(b == x, F.lit(signed(SEEDS[pairs[x] if complement else x])).cast("long")).otherwise(out)
    return out


def _fold(kmer: Column, reverse: bool) -> Column:
    s, k = kmer, F.length(kmer)
    term = lambda i: rotl(_seed(s.substr(i + 1, F.lit(1)), reverse), (i if reverse else k - 1 - i) % 64)
    return F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseXOR(term(i)))


def forward_hash(kmer: Column | str) -> Column:
    """64-bit hash of a k-mer on its own strand. N counts as nothing; case is ignored."""
    return _fold(col(kmer), False)


def reverse_hash(kmer: Column | str) -> Column:
    return _fold(col(kmer), True)


def unsigned_least(a: Column, b: Column) -> Column:
    sign = F.lit(-(1 << 63)).cast("long")
    return F.when(a.bitwiseXOR(sign) <= b.bitwiseXOR(sign), a).otherwise(b)


def canonical_hash(kmer: Column | str) -> Column:
    return unsigned_least(forward_hash(kmer), reverse_hash(kmer))


def seeded_hash(kmer: Column | str, seed: int, canonical: bool = True) -> Column:
    """The hash of a k-mer under a seed, of both strands or of its own."""
    return _seeded(canonical_hash(kmer) if canonical else forward_hash(kmer), F.length(col(kmer)), F.lit(seed))


def roll(forward: Column, out_base: Column, in_base: Column, k: int) -> Column:
    """The forward hash after one base left and one entered."""
    return rotl(forward, 1).bitwiseXOR(rotl(_seed(out_base), k % 64)).bitwiseXOR(_seed(in_base))


def roll_reverse(reverse: Column, out_base: Column, in_base: Column, k: int) -> Column:
    x = reverse.bitwiseXOR(_seed(out_base, True)).bitwiseXOR(rotl(_seed(in_base, True), k % 64))
    return rotr(x, 1)


def _seeded(base: Column, k: Column, i: Column) -> Column:
    @F.pandas_udf("long")
    def times(b: pd.Series, k: pd.Series, i: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            x = b.to_numpy(np.int64).view(np.uint64) * (i.to_numpy(np.uint64) ^ (k.to_numpy(np.uint64) * np.uint64(MULTI_SEED)))
        return pd.Series((x ^ (x >> np.uint64(MULTI_SHIFT))).view(np.int64))

    return times(base, k.cast("long"), i.cast("long"))


def multi_hash(kmer: Column | str, m: int, canonical: bool = True) -> Column:
    """Array of m hashes of a k-mer: the base hash and m - 1 seeded ones."""
    base = canonical_hash(kmer) if canonical else forward_hash(kmer)
    return F.array(base, *[_seeded(base, F.length(col(kmer)), F.lit(i)) for i in range(1, m)])


def checked_hash(kmer: Column | str) -> Column:
    """struct(valid, loc_n, hash): the hash where all bases are ACGT, else the place of the last other one."""
    s = col(kmer)
    bad = F.rlike(s, F.lit("[^ACGTacgt]"))
    loc = F.when(bad, F.length(s) - 1 - F.length(F.regexp_extract(s, "([ACGTacgt]*)$", 1))).otherwise(0)
    return F.struct((~bad).alias("valid"), loc.cast("int").alias("loc_n"), F.when(bad, F.lit(0)).otherwise(canonical_hash(s)).alias("hash"))


def fingerprint(h: Column, hb: int) -> Column:
    """The low hb bits of a hash."""
    return h if hb >= 64 else h.bitwiseAND(F.lit(signed((1 << hb) - 1)))


# ------------------------------------------------------------ whole reads

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
_FORWARD = np.array([*SEEDS.values(), 0], np.uint64)
_REVERSE = np.array([*reversed(SEEDS.values()), 0], np.uint64)


def _rot(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64) & np.uint64(63)
    return (x << n) | (x >> ((np.uint64(64) - n) & np.uint64(63))) * (n != 0)


def read_hashes(seq: bytes, k: int) -> np.ndarray:
    """Canonical hashes of all windows of k bytes of a read, from prefix folds of rotated seeds."""
    c = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(len(c), dtype=np.int64)
    fold = lambda x: np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(x)))
    f, r = fold(_rot(_FORWARD[c], -at % 64)), fold(_rot(_REVERSE[c], at % 64))
    start = at[:n]
    forward = _rot(f[k:] ^ f[:n], (k - 1 + start) % 64)
    reverse = _rot(r[k:] ^ r[:n], -start % 64)
    return np.minimum(forward, reverse)


def kmer_hashes(rows: np.ndarray) -> np.ndarray:
    """Canonical hashes of equally long k-mers, the rows of a matrix of bytes: one step of all of them a letter."""
    k = rows.shape[1]
    f, r = np.zeros((2, len(rows)), np.uint64)
    for i, c in enumerate(_CODE[rows].T):
        f ^= _rot(_FORWARD, np.array(k - 1 - i))[c]
        r ^= _rot(_REVERSE, np.array(i))[c]
    return np.minimum(f, r)


def hash_table(kmers: DataFrame, m: int, kmer: str = "kmer") -> DataFrame:
    """kmer, h, valid, loc_n, hash: ``multi_hash`` and the fields of ``checked_hash`` of each row's k-mer, of any lengths.

    For large tables: an Arrow function of whole rows. Beside a function of a
    column, Spark keeps the rows themselves, on disk where memory is short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h, loc = np.zeros((n, m), np.uint64), np.zeros(n, np.int32)
            bad, null = np.zeros(n, bool), np.zeros(n, bool)
            by: dict[int, list[int]] = {}
            texts = batch.column(0).to_pylist()
            for i, x in enumerate(texts):
                by.setdefault(-1 if x is None else len(x), []).append(i)
            null[by.pop(-1, [])] = True
            for k, at in by.items():
                raw = "".join([texts[i] for i in at]).encode("ascii", "replace")  # a byte a letter
                rows = np.frombuffer(raw, np.uint8).reshape(len(at), k)
                other = _CODE[rows] == 4
                bad[at] = other.any(axis=1)
                loc[at] = np.where(bad[at], k - 1 - other[:, ::-1].argmax(axis=1), 0) if k else 0
                h[at, 0] = base = kmer_hashes(rows)
                for j in range(1, m):
                    x = base * np.uint64(j ^ (k * MULTI_SEED & MASK))
                    h[at, j] = x ^ (x >> np.uint64(MULTI_SHIFT))
            values = pa.array(h.view(np.int64).ravel(), mask=np.repeat(null, m))
            told = [
                batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), values), pa.array(~bad, mask=null), pa.array(loc),
                pa.array(np.where(bad, np.uint64(0), h[:, 0]).view(np.int64), mask=null),
            ]
            yield pa.RecordBatch.from_arrays(told, ["kmer", "h", "valid", "loc_n", "hash"])

    return kmers.select(kmer).mapInArrow(run, "kmer string, h array<bigint>, valid boolean, loc_n int, hash bigint")


def hash_reads(reads: DataFrame, k: int, hb: int = 64, seq: str = "seq", strict: bool = True) -> DataFrame:
    """key BIGINT: fingerprint of every canonical k-mer; strict leaves out windows with other than ACGT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                told = []
                for text in batch.column(0).slice(a, 512).to_pylist():
                    if not text or len(text) < k:
                        continue
                    raw = text.encode()
                    h = read_hashes(raw, k)
                    if strict:
                        bad = np.concatenate(([0], np.cumsum(_CODE[np.frombuffer(raw, np.uint8)] == 4)))
                        h = h[bad[k:] == bad[: len(h)]]
                    told.append(h if hb >= 64 else h & np.uint64((1 << hb) - 1))
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(told).view(np.int64))], ["key"])

    return reads.select(seq).mapInArrow(run, "key long")


#: Multiplier and shift of MurmurHash2.
MURMUR_M, MURMUR_R = 0x5BD1E995, 24


def _murmur2(rows: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of equally long byte strings, the rows of a matrix: one step of all of them a word."""
    m, low = np.uint64(MURMUR_M), np.uint64(0xFFFFFFFF)
    n = rows.shape[1]
    whole = n // 4 * 4
    words = np.ascontiguousarray(rows[:, :whole]).view("<u4").astype(np.uint64)
    h = np.full(len(rows), (seed ^ n) & 0xFFFFFFFF, np.uint64)
    for x in words.T:
        x = x * m & low
        h = (h * m & low) ^ ((x ^ (x >> np.uint64(MURMUR_R))) * m & low)
    if n > whole:
        rest = np.zeros(len(rows), np.uint64)
        for i in range(whole, n):
            rest |= rows[:, i].astype(np.uint64) << np.uint64(8 * (i - whole))
        h = (h ^ rest) * m & low
    h = (h ^ (h >> np.uint64(13))) * m & low
    return h ^ (h >> np.uint64(15))


def murmur2(data: bytes, seed: int = 0) -> int:
    """32-bit MurmurHash2 of bytes, little-endian words."""
    return int(_murmur2(np.frombuffer(data, np.uint8).reshape(1, -1), seed)[0])


def murmur2_all(data: list[bytes | None], seed: int = 0) -> list[int | None]:
    """Of many strings, those of one length at a time."""
    out: list[int | None] = [None] * len(data)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(data):
        if x is not None:
            by.setdefault(len(x), []).append(i)
    for n, at in by.items():
        rows = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), n)
        for i, h in zip(at, _murmur2(rows, seed).tolist(), strict=True):
            out[i] = h
    return out


@F.pandas_udf(LongType())
def murmur2_udf(s: pd.Series) -> pd.Series:
    return pd.Series(murmur2_all([None if x is None else x.encode() for x in s]), dtype="Int64")


def kmer_murmurs(reads: DataFrame, k: int, key: str = "read_id", seq: str = "seq") -> DataFrame:
    """key, hashes: MurmurHash2 of every k-mer of the read as it stands, then of its reverse complement. Shorter reads have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                if len(raw) < k:
                    told.append([])
                    continue
                both = (np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), k) for x in (raw, raw[::-1].translate(_COMPLEMENT)))
                told.append(np.concatenate([_murmur2(x, 0) for x in both]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(pa.int64()))], ["key", "hashes"])

    kind = reads.schema[key].dataType.simpleString()
    return reads.select(key, seq).mapInArrow(run, f"key {kind}, hashes array<bigint>").withColumnRenamed("key", key)


def minhash_sketch(hashes: Column, n: int) -> Column:
    """The n least distinct values of an array, ascending. Over ``kmer_murmurs`` it is a sketch of both strands."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, n)
