"""Secret scanning: fixed patterns, plus dictionary-primed zstandard novelty.

A string near a sensitive word is measured by its marginal compressed bytes:
what the surrounding text plus the string needs beyond the surrounding text
alone, with a dictionary of code words and identifiers. What compresses well
is an identifier or is said nearby; what doesn't is reported as ``novel``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

#: The base patterns, by kind, in order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows within REACH characters sensitive.
SENSITIVE = ("secret", "token", "passw", "pwd", "key", "auth", "bearer", "credential", "private", "signature")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE)
REACH = 48
AROUND = 256
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Marginal compressed bytes a character from which a candidate is reported.
NOVELTY = 0.7

#: Code words and identifiers that prime the compressor: a dictionary, not patterns.
IDENTIFIERS = (
    "access account address algorithm api app application array async attribute auth authorization await base64 bearer body boolean "
    "bucket buffer build byte cache callback certificate char class client cluster code column config configuration connection const "
    "constructor container content context controller cookie count create credential current data database date debug decode default "
    "delete description device digest directory document domain element email enable encode encrypt endpoint environment error event "
    "example exception expires export extends false field file filter float format from function generate get github global google "
    "group handler hash header host html http https identifier image implements import index input instance integer interface "
    "internal issuer item iterator java javascript json key language length level library license list load local location log login "
    "main manager map memory message method model module name namespace network node null number object option output package page "
    "parameter parent parse password path payload permission platform pointer policy port prefix private process production profile "
    "project property protected protocol provider public query queue random read record reference refresh region register release "
    "remove request require reset resource response result return role root route schema scope script secret security select self "
    "server service session set setting signature size source static status storage stream string struct subject system table tag "
    "target template test text thread time timestamp token true type undefined unique update upload url user username uuid valid "
    "value variable vector version view virtual web window worker write abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)


def _primed() -> zstandard.ZstdCompressor:
    words = IDENTIFIERS.split()
    shapes = [*words, *(w.upper() for w in words), *(w.capitalize() for w in words)]
    return zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(" ".join(shapes).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)


_compressor: list[zstandard.ZstdCompressor] = []


def marginal_bytes(context: str, candidate: str) -> int:
    """Compressed bytes that the candidate adds to its context."""
    if not _compressor:
        _compressor.append(_primed())
    c, said = _compressor[0], context.encode("utf-8", "replace")
    return len(c.compress(said + candidate.encode("utf-8", "replace"))) - len(c.compress(said))


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping by kind, whole matches in code points."""
    found = []
    # A text without a pattern's fixed part can't match it.
    if any(w in lower for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, lower: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings in sensitive context, none overlapping a base span."""
    if not any(w in lower for w in SENSITIVE):
        return []
    found, taken, near = [], sorted((s, e) for s, _, e in base), 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while near < len(taken) and taken[near][1] <= s:
            near += 1
        if any(a < e for a, b in taken[near : near + 3] if b > s):
            continue
        word = m[0]
        if not _SENSITIVE.search(text, max(0, s - REACH), s):
            continue
        if marginal_bytes(text[max(0, s - AROUND) : s] + text[e : e + AROUND], word) >= NOVELTY * len(word):
            found.append((s, 3, e))
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, novelty spans) of a whole text; null is empty."""
    if not text:
        return [], []
    lower = text.lower()
    base = base_spans(text, lower)
    return base, novel_spans(text, lower, base)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, text), one row per row of docs; by start, then kind.

    Null and empty texts have no spans; ids may repeat or be null, repeated rows
    are scanned each. A very long text is scanned whole, in one task. Two kinds
    may start at one place and are told both, in the kinds' order. No rows, no
    result. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for batch in slices(batches):
            spans = []
            for t in batch.column(1).to_pylist():
                base, novel = scan(t)
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "text": t[s:e]} for s, k, e in sorted(base + novel)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,text:string>>")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every row of docs."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"), n("novel"))
