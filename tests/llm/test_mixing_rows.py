"""Every row of the realised mixture against plain Python; the pipeline on odd tables."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from helixion.llm import mixing
from helixion.llm.common import Scratch

SCHEMA = "doc_id long, source string, text string"


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain(rows, alpha, norm, budget, block):
    """doc_id -> list of (pass, block, place)."""
    by = collections.defaultdict(list)
    for i, s, t in rows:
        by[s].append((i, len(t.split()), number(f"17:{i}:{t}")))
    total = sum(n for docs in by.values() for _, n, _ in docs)
    out = []
    for docs in by.values():
        tokens = sum(n for _, n, _ in docs)
        want = int((tokens / total) ** alpha / norm * budget + 1e-6)
        bits = max(1, (-(-len(docs) // block) - 1).bit_length()) if len(docs) > block else 1
        passes, rest = divmod(want, tokens)
        for k in range(passes + 1):
            order = sorted((number(f"{u}:{k}"), i, n) for i, n, u in docs)
            if k == passes:
                spent, taken = 0, []
                for v, i, n in order:
                    spent += n
                    if spent > rest:
                        break
                    taken.append((v, i, n))
                order = taken if rest else []
            places = collections.Counter()
            for v, i, _ in order:
                b = v >> (60 - bits)
                out.append((i, k, b, places[b]))
                places[b] += 1
    return sorted(out)


def test_every_row_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(21)
    rows = [(i, rng.choice("aaaaaaaabbbc"), "w " * rng.randrange(1, 30)) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark, "t")
    src = mixing.source_table(mixing.drawn_items(df, 17))
    for target in (mixing.Target(max_repetition=2.0), mixing.Target(max_repetition=3.0), mixing.Target(entropy=0.95)):
        alpha, norm, budget = mixing.solve(src, target)
        got = mixing.realised(scratch, df, target).collect()
        assert sorted((r.doc_id, r["pass"], r.block, r.place) for r in got) == plain(rows, alpha, norm, budget, 16)
        copies = {r.doc_id: r.copies for r in mixing.mixed(scratch, df, target).collect()}
        assert collections.Counter(r.doc_id for r in got) == collections.Counter({i: n for i, n in copies.items() if n})


def test_passes_have_their_own_order(spark):
    rows = [(i, "a" if i % 20 else "b", "w " * 10) for i in range(400)]
    got = mixing.realised(Scratch(spark, "t"), spark.createDataFrame(rows, SCHEMA), mixing.Target(max_repetition=2.0)).filter("source = 'b'").collect()
    order = {k: [r.doc_id for r in sorted(got, key=lambda r: (r.block, r.place)) if r["pass"] == k] for k in (0, 1)}
    assert len(order[0]) >= 18 and len(order[1]) >= 18 and order[0] != order[1]


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "s", "a b"), (1, "s", "a b"), (2, None, None), (None, "t", "c"), (4, "t", "")], SCHEMA)
    for c in ("copies", "Weight", "tokens", "u", "bits", "passes", "last", "pass", "block"):
        df = df.withColumn(c, F.lit("x"))
    out = mixing.mixed(Scratch(spark, "t"), df, mixing.Target(max_repetition=2.0))
    assert sorted(out.columns) == sorted(["doc_id", "source", "text", "tokens", "u", "bits", "passes", "last", "pass", "block", "copies", "weight"])
    assert out.count() == 5 and len({r.copies for r in out.filter("doc_id = 1").collect()}) == 1
    assert mixing.op7(spark, df).count() >= 4 and mixing.op7(spark, df.limit(0)).count() == 0


def test_pipeline_equals_its_sql(spark, duck, same):
    import corpus_pipeline as cp

    same(cp.run(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001").sql(cp.ORACLE_SQL))


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    long = " ".join(f"word{i} more" for i in range(50_000))
    clean = " ".join(f"plain word number {i}" for i in range(20))
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (2, None, None, None, None), (None, clean.replace("plain", "other"), "en", None, 3), (3, "", "en", "s", 0), (4, long, "de", "t", 9), (5, long, "de", "t", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, given in (("odd", rows), ("empty", [])):
        df = spark.createDataFrame(given, schema)
        for c in ("size", "shard", "_row", "copies", "id", "kept"):
            df = df.withColumn(c, F.lit(1))
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = collections.Counter(r.doc_id for r in cp.run(spark, f"file://{tmp_path}/odd").collect())
    assert set(got) == {1, None, 4} and max(got.values()) <= 2
    assert cp.run(spark, f"file://{tmp_path}/empty").count() == 0
