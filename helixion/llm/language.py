"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and the
1- to 3-grams of code points are hashed to BUCKETS features. Counts of a
bounded sample give a log-probability matrix (languages x BUCKETS), which is
broadcast in blocks of BLOCK_LANGS languages; scoring multiplies each text's
sparse counts with it in numpy, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices
from .common import Scratch

BUCKETS = 1 << 14
#: Bound of the fit: about this many labelled documents, chosen by a hash of id and text over the whole table. All their languages are learned.
TRAIN_DOCS = 20_000
#: Languages in one matrix: 64 MB.
BLOCK_LANGS = 512
SMOOTHING = 0.5
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; built once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of the whole text; None where it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others stays, as a space
    c = np.where(is_letter, codes, np.uint32(32))[keep]
    c = np.concatenate(([np.uint32(32)], c)).astype(np.uint32)
    a, b, d = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
    two = (a[:-1] ^ (a[:-1] >> np.uint32(15))) + b[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + d[2:]
    return np.concatenate([(x * np.uint32(0x2C1B3C6D)) >> np.uint32(18) for x in (d, two, three)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (f := features(text)) is not None:
                if lang not in total:
                    total[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
                total[lang] += np.bincount(f, minlength=BUCKETS)
                docs[lang] += 1
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], docs[lang]))], ["lang", "bucket", "n"]
        )


#: (score of the best language, that language, sum of the likelihoods of all so far over the best one's)
Best = tuple[float, str | None, float]
NOTHING: Best = (-np.inf, None, 0.0)


@dataclass
class Block:
    """Some of the languages: their log priors, and log-probabilities by bucket."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def better(self, f: np.ndarray | None, so_far: Best) -> Best:
        if f is None:
            return so_far
        n = np.bincount(f, minlength=BUCKETS)
        at = np.flatnonzero(n)
        s = self.prior + n[at] @ self.logp[at]
        i = int(np.argmax(s))
        before, lang, others = so_far
        best = max(before, float(s[i]))
        total = others * np.exp(before - best) + np.exp(s - best).sum()
        return best, self.langs[i] if s[i] > before else lang, float(total)


def verdict(best: Best) -> tuple[str, float]:
    """(language, its share of all likelihoods)."""
    return (UNKNOWN, 0.0) if best[1] is None else (best[1], 1 / best[2])


@dataclass
class Model:
    blocks: list[Block]

    def score(self, f: np.ndarray | None) -> tuple[str, float]:
        return verdict(reduce(lambda best, b: b.better(f, best), self.blocks, NOTHING))


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, block_langs: int = BLOCK_LANGS) -> Model:
    """A model of labelled(doc_id, text, lang), fitted on about train_docs of its rows.

    The sample takes a share of rows by a 64-bit hash of id and text, over all
    of the table; null and repeated ids are drawn by their texts, and rows that
    repeat both stand once, so they can't swell it. All its languages are
    learned, in order of name; the driver holds one block's counts at a time.
    Nothing labelled: an empty model.
    """
    rows = labelled.filter("lang IS NOT NULL")
    scratch = Scratch(labelled.sparkSession, "language")
    share = min(1.0, train_docs / max(1, rows.count()))
    drawn = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("u"))
    if share < 1:
        drawn = drawn.filter(F.col("u") < int((2 * share - 1) * (1 << 63)))
    sample = drawn.dropDuplicates(["u", "lang"])
    counts = scratch.cut(sample.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    docs = {r["lang"]: r["n"] for r in counts.filter("bucket = -1").collect()}  # at most a row a sampled document
    langs, total, blocks = sorted(docs), sum(docs.values()), []
    for a in range(0, len(langs), block_langs):
        own = langs[a : a + block_langs]
        row = {x: i for i, x in enumerate(own)}
        got = counts.filter((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1]) & (F.col("bucket") >= 0)).toArrow()
        seen = np.full((BUCKETS, len(own)), SMOOTHING)
        seen[got["bucket"].to_numpy(), [row[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
        blocks.append(Block(own, np.log(np.array([docs[x] for x in own]) / total), np.log(seen / seen.sum(axis=0))))
    scratch.drop(counts)
    return Model(blocks)


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, one row per row of docs, repeated ones too.

    Null texts, texts without letters and an empty model give und with score 0;
    a very long text is scored whole; ties go to the first language by name. No
    rows, no result. Other columns are ignored, whatever their names.
    """
    fields = [f for f in docs.select(*keep).schema]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    out = docs.select(*keep, F.col("text").alias("_text"), F.lit(NOTHING[0]).alias("_best"), F.lit(None).cast("string").alias("_lang"), F.lit(NOTHING[2]).alias("_sum"))
    names, k = [*keep, "_text", "_best", "_lang", "_sum"], len(fields)

    def scorer(block: Block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                so_far = zip(*[batch.column(i).to_pylist() for i in (k + 1, k + 2, k + 3)], strict=True)
                got = [shared.value.better(features(t), x) for t, x in zip(batch.column(k).to_pylist(), so_far, strict=True)]
                last = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(k + 1)], *last], names)

        return run

    for block in model.blocks:
        out = out.mapInArrow(scorer(block), ", ".join([*kept, "_text string, _best double, _lang string, _sum double"]))
    found = F.col("_lang").isNotNull()
    return out.select(*keep, F.when(found, F.col("_lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(found, 1 / F.col("_sum")).otherwise(0.0).alias("score"))


def op6(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 is not 2; a null id counts as the empty text."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    docs = documents.select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    model = fit(docs.filter("NOT held_out"))
    return predict(spark, docs.select("doc_id", "held_out", "text"), model, ("doc_id", "held_out"))
