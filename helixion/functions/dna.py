"""DNA string functions as Column expressions. A sequence is a STRING over ACGT (N and lower case where stated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases with their complements, and two-bit codes in order.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"
CODES = "ACGT"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Case is kept, N stays N. A character without a complement gives null."""
    s = col(seq)
    return F.when(F.rlike(s, F.lit("^[ACGTNacgtn]*$")), F.reverse(F.translate(s, BASES, COMPLEMENTS)))


def complement_base(base: Column | str) -> Column:
    """Upper-case complement of one base; null for others."""
    b = F.upper(col(base))
    return F.when(b.isin(*CODES), F.translate(b, "ACGT", "TGCA"))


def to_upper(seq: Column | str) -> Column:
    return F.upper(col(seq))


def to_lower(seq: Column | str) -> Column:
    """Lower case; null where a character isn't one of ACGTN."""
    s = col(seq)
    return F.when(F.rlike(s, F.lit("^[ACGTNacgtn]*$")), F.lower(s))


def subsequence(seq: Column | str, pos: Column | int, length: Column | int) -> Column:
    """0-based; a length beyond the end is clamped."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return col(seq).substr(lit(pos) + F.lit(1), lit(length))


def base_at(seq: Column | str, pos: int) -> Column:
    """The base at a 0-based place; null outside."""
    return F.nullif(subsequence(seq, pos, 1), F.lit(""))


def append_base(seq: Column | str, base: str) -> Column:
    return F.concat(col(seq), F.lit(base))


def prepend_base(base: str, seq: Column | str) -> Column:
    return F.concat(F.lit(base), col(seq))


def drop_first(seq: Column | str) -> Column:
    s = col(seq)
    return s.substr(F.lit(2), F.greatest(F.length(s), F.lit(1)))


def replace_base(seq: Column | str, pos: int, base: str) -> Column:
    return F.overlay(col(seq), F.lit(base), pos + 1, 1)


def n_bases(seq: Column | str) -> Column:
    return F.length(col(seq))


def packed_bytes(seq: Column | str) -> Column:
    """Bytes that two bits a base need."""
    return F.ceil(F.length(col(seq)) / 4).cast("int")


def sanitize(seq: Column | str) -> Column:
    """Upper case with every other character taken as A, as two-bit packing does."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "A")


def encode(seq: Column | str) -> Column:
    """Two bits a base, first base highest, as a BIGINT; null beyond 31 bases or for an empty sequence."""
    s = col(seq)
    return F.when(F.length(s).between(1, 31), F.conv(F.translate(sanitize(s), CODES, "0123"), 4, 10).cast("long"))


def decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(code).cast("string"), 10, 4), k, "0"), "0123", CODES)


def reverse_complement_code(code: Column | str, k: int) -> Column:
    """Of an encoded k-mer, on its bits."""
    c = col(code)
    digits = F.sequence(F.lit(0), F.lit(k - 1))
    digit = lambda i: F.lit(3).cast("long") - F.call_function("shiftright", c, 2 * i).bitwiseAND(F.lit(3).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 2).bitwiseOR(digit(i)))


def is_palindrome(seq: Column | str) -> Column:
    """Equals its own reverse complement (so its length is even)."""
    s = col(seq)
    return (F.length(s) % 2 == 0) & (s == reverse_complement(s))


def is_hairpin(seq: Column | str, length: int | None = None) -> Column:
    """Its first bases are the reverse complement of its last ones; by default half of it."""
    s = col(seq)
    n = F.floor(F.length(s) / 2).cast("int") if length is None else F.lit(length)
    return s.substr(F.lit(1), n) == reverse_complement(F.right(s, n))


def is_homopolymer(seq: Column | str) -> Column:
    s = col(seq)
    return (F.length(s) > 0) & (s == F.repeat(F.left(s, F.lit(1)), F.length(s)))


def kmers_before(kmer: Column | str, order: str = "ACGT") -> Column:
    """The four predecessors. order: ACGT as for encoded k-mers, ATGC as for strings."""
    s = col(kmer)
    return F.array(*[F.concat(F.lit(b), s.substr(F.lit(1), F.length(s) - 1)) for b in order])


def kmers_after(kmer: Column | str, order: str = "ACGT") -> Column:
    s = col(kmer)
    return F.array(*[F.concat(drop_first(s), F.lit(b)) for b in order])


def parse_number(text: Column | str, kind: str = "double") -> Column:
    """Leading number of a text; null where there is none."""
    return F.nullif(F.regexp_extract(col(text), r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1), F.lit("")).cast(kind)


def header_field(header: Column | str, name: str) -> Column:
    """The value after ``name:`` up to the next space; null where it is missing."""
    return F.nullif(F.regexp_extract(col(header), rf"(?:^|[ >]){name}:([^ ]*)", 1), F.lit(""))


def timestamp_text(ts: Column | None = None, pattern: str = "yyyy-MM-dd.HH:mm:ss") -> Column:
    return F.date_format(F.current_timestamp() if ts is None else ts, pattern)


def canonical(kmer: Column | str) -> Column:
    s = col(kmer)
    return F.least(s, F.reverse(F.translate(s, "ACGT", "TGCA")))
