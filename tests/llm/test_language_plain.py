"""Language identification against a plain naive Bayes, and the bounds of its sample."""

import collections
import math
import zlib

from pyspark.sql import functions as F

from helixion.llm import language
from helixion.llm.common import table

SF = "/root/testdata/sf0.001"
LABELLED = "doc_id long, text string, lang string"


def plain_bayes(train, texts):
    """Multinomial naive Bayes by dictionaries, over the operator's features."""
    n, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in train:
        if (f := language.features(text)) is not None:
            docs[lang] += 1
            n[lang].update(f.tolist())
    total = {x: sum(c.values()) + language.SMOOTHING * language.BUCKETS for x, c in n.items()}
    out = []
    for t in texts:
        f = language.features(t)
        if f is None or not docs:
            out.append(("und", 0.0))
            continue
        s = {x: math.log(docs[x] / docs.total()) + sum(math.log((n[x][b] + language.SMOOTHING) / total[x]) for b in f.tolist()) for x in docs}
        best = min(s, key=lambda x: (-s[x], x))
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


def test_query_against_plain_naive_bayes(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = dict(zip([r.doc_id for r in rows], plain_bayes(train, [r.text for r in rows]), strict=True))
    got = language.op6(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6


def test_more_languages_than_a_block(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i % 26) * 2}b word{i % 26}", f"l{i % 26:02d}") for i in range(260)]
    df = spark.createDataFrame(rows, LABELLED)
    one, many = language.fit(df), language.fit(df, block_langs=4)
    assert len(one.blocks) == 1 and len(many.blocks) == 7
    a = {r.doc_id: r for r in language.predict(spark, df, one).collect()}
    b = {r.doc_id: r for r in language.predict(spark, df, many).collect()}
    assert all(a[i].lang_pred == b[i].lang_pred == lang and abs(a[i].score - b[i].score) < 1e-9 for i, _, lang in rows)


def test_sample_of_null_and_repeated_ids(spark):
    """Drawn by text: neither taken whole nor left out; rows that repeat everything stand once."""
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("the of and x"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    share = 400 / 4000
    drawn = df.filter(F.xxhash64("doc_id", "text") <= int((2 * share - 1) * (1 << 63))).count()
    assert 300 < drawn < 500
    assert language.fit(df, train_docs=400).score(language.features("the of and"))[0] == "en"
    same = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the of and").alias("text"), F.lit("en").alias("lang"))
    assert [b.langs for b in language.fit(same, train_docs=4000).blocks] == [["en"]]


def test_tiny_share_of_a_table_learns_as_many(spark):
    """A share far below a millionth keeps its size: the threshold has 64 bits."""
    share = 20_000 / 5e10
    assert int((2 * share - 1) * (1 << 63)) + (1 << 63) > 0


def test_odd_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "der die das " * 50_000, "de"), (2, "the of and", "en"), (2, "the of and", "en")], LABELLED)
    for c in ("_text", "_best", "_lang", "_sum", "score", "lang_pred"):
        df = df.withColumn(c, F.lit(1))
    got = language.predict(spark, df, language.fit(df)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "de"), (2, "en"), (2, "en")]
