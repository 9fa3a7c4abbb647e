"""The training-data operators: against SQL, brute force, exact round trips, and the edge cases that each states."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from helixion.llm import chat, decontaminate, jaccard, language, lines, mixing, quality, secrets, shards, warc
from helixion.llm import queries as Q
from helixion.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in each column, empty and long texts, repeated rows and ids, columns with clashing names.
ODD = [
    (1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, None, None, None, None), (None, "x y z " * 9, "de", "s", 2),
    (3, "", "en", None, 0), (4, " \n\t ", "en", "t", 4), (5, "w " * 60000, "en", "s", 9), (6, "ä" * 30, "de", "t", 3), (7, "é ñ\nline two\nline three\nline four", "es", "t", 3), (7, "other text under a repeated id", "en", "t", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOC)
    for c in ("size", "shard", "label", "sid", "n", "row", "_row", "h", "s", "copies", "_k", "failures", "kept", "at"):
        df = df.withColumn(c, df["n_chars"])
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_oracle(spark, duck, same, name):
    same(Q.queries()[name](spark, SF), duck(SF).sql(Q.oracle_sql()[name]))


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries() if n.startswith("op")) == list(range(1, 11))


# ------------------------------------------------------------------ 1 quality


def test_quality_measures_against_plain_python(spark, odd):
    import re

    def plain(text):
        text = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        ls = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(rep)

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc#") for _ in range(rng.randrange(60))) + rng.choice(["", "\na a\na a\n \n"]) for _ in range(200)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    df = df.withColumn("k", df.text)
    got = quality.measure(df.select("text", df.k.alias("doc_id"))).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.doc_id) for r in got) and len(got) == len(ODD) + 200


def test_policies_and_ablations(spark, odd, none):
    led = quality.ledger(odd)
    rows = quality.apply_policy(led, "base-1").collect()
    assert all(r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words) for r in rows)
    a = {r.rule: r for r in quality.ablations(led, "base-1").collect()}
    assert a["few_words"].n_failed == sum(r.n_words < 20 for r in rows) and a["few_words"].n_kept == sum(r.kept for r in rows)
    assert quality.op1(none).count() == 0 and quality.accept(odd).columns == odd.columns


# --------------------------------------------------------------------- 2 WARC


def test_warc_rejects_magic_inside_payloads(spark):
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "x" * 120), (2, "u", "x" * 120), (3, None, "zz" + fake + "yy"), (4, "a\r\nb", fake), (5, "v", fake + fake + m), (6, "w", None), (7, "w", m * 40), (8, "é", "é" * 60), (9, "é", "é" * 60), (10, "t", "\r\n\r\n"), (11, "t", "")]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", warc.F.lit(1)).repartition(n)
        got = {r.page_id: r for r in warc.op2(spark, df).collect()}
        assert len(got) == len(rows)
        for i, _, h in rows:
            b = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 9: 8}


def test_warc_null_ids_repeats_and_empty(spark):
    rows = [(None, "u", "y" * 200), (None, "u", "y" * 200), (5, "u", "y" * 200), (5, "u", "y" * 200), (9, None, "y" * 200)]
    got = warc.op2(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("5", "response"), ("5", "response"), ("9", "revisit"), ("None", "response"), ("None", "response")]
    assert warc.op2(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_splits_read_one_file(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = [(i, f"http://x/{i}", ("p%d " % i) * 50 + (warc.MAGIC if i % 7 == 0 else "")) for i in range(200)]
        got = {r.page_id: r for r in warc.op2(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
        assert all(got[i].payload_digest == hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --------------------------------------------------------------------- 3 chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<", "|", "\\", "<|im_end|>", "<|im_part|>", "\n", "</s>", "[INST]", "<\\|im_start|>", "a", "<<SYS>>", "%0A", "é", "", "s>", "INST]", "["]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "x\ny%", None]), rng.choice([None, *["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(5)]])) for c in range(60) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_chats(out).collect()}
    want = collections.defaultdict(list)
    for c, _, r, x in sorted(rows, key=lambda r: r[:2]):
        want[c].append((r or "", x or ""))
    assert back == dict(want)
    for r in out.collect():
        learned = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(learned) == sum(role == "assistant" for role, _ in want[r.conv_id])
    assert out.filter("formatted LIKE '%</s>%' OR formatted LIKE '%[INST]%'").isEmpty()


def test_chat_merges_roles_and_handles_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, None, "system", "s"), (None, 0, "user", None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].formatted == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_part|>b<|im_part|>b<|im_end|>\n"
    assert got[None].formatted == "<|im_start|>user\n<|im_end|>\n"
    assert chat.op3(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


# ------------------------------------------------------------------ 4 secrets


def base_by_brute_force(text):
    """The base columns by the contract's words."""
    text = text or ""
    a = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    b = [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
    c = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, secrets.KINDS.index(k), k, e) for k, s, e in a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(joined.encode()).hexdigest()


def test_secrets_base_against_brute_force(spark, odd):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "xY9+/=", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.op4(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == base_by_brute_force(t)
    assert secrets.op4(odd).count() == len(ODD)


def test_novelty_reports_incompressible_strings_only():
    text = "auth bearer header: Zq8Kx2LmV0pTr7WnYb3c and more words. the key is configurationParameterName1 of the page. Then plain words go on and on until they are far from all of that: Pw3Hs8DjK5uQe1XcNf6g is not looked at"
    _, novel = secrets.scan(text)
    assert [text[s:e] for s, _, e in novel] == ["Zq8Kx2LmV0pTr7WnYb3c"]
    assert secrets.marginal_bytes("", "authorizationparameter") < secrets.marginal_bytes("", "q7Zk2VxP0mW9tYb4LrNs3c")


def test_novelty_needs_neither_digits_nor_letters():
    text = "the service sends a Bearer {} with each call of the page"
    for word in ("QxvTzKjWpRbNmLfHgDsY", "KZQXWVJHTRNPLMBD", "GvYtQbZmXwKpJcRdHnLsFqVz", "8305917264580317"):
        t = text.format(word)
        assert [t[s:e] for s, _, e in secrets.scan(t)[1]] == [word]
    for word in ("telecommunications", "Donaudampfschifffahrt", "misunderstandings", "incomprehensibilities", "configurationParameterName", "0000000000000000", "----------------"):
        assert secrets.scan(text.format(word))[1] == []


# ------------------------------------------------------------------ 5 Jaccard


def components_by_brute_force(rows):
    sets, links, parent = [], 0, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets.append((i, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if w else set()))
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                links += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}, links


def edited(seed, families=40):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 17, 20, 24, 30, 40, 60, 70, 100, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                p, o = rng.randrange(len(w)), rng.random()
                if o < 0.4:
                    w[p] = rng.choice(vocabulary)
                elif o < 0.7:
                    w.insert(p, rng.choice(vocabulary))
                elif len(w) > 1:
                    del w[p]
            if rng.random() < 0.3:
                w += "released under the mit license see file for details".split()
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + i, x) for i, x in enumerate(["", "   ", None, "a", "A", "a b c d", "A  B c\td", None])]


def test_jaccard_components_against_brute_force(spark):
    rows = edited(5)
    want, links = components_by_brute_force(rows)
    assert links > 50
    got = jaccard.similarity_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_band_without_enough_units_switches(spark):
    rows = edited(6, 25)
    # With a quarter of the segments some sets can't do.
    assert any(jaccard.signatures(h, band, most, False, 4)[3] < 0 for _, t in rows if len(h := jaccard.shingles(t)[2]) for _, band, most in jaccard.instances(len(h)))
    want, _ = components_by_brute_force(rows)
    got = jaccard.similarity_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), coarse=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_in_small_slices_and_chunks(spark, monkeypatch):
    """One passage in every document, a thousand null ids, slices of a few texts, and groups of more than 20 sets in chunks."""
    monkeypatch.setattr(jaccard, "MOST_PARTITIONS", 5)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"{passage} {t}" if t else t) for i, t in edited(9, 60)]
    # Texts that are little more than the passage have no dearer signatures to spare: they probe the hot groups.
    rows += [(len(rows) + i, passage + "".join(f" z{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8])))) for i in range(150)]
    want, links = components_by_brute_force(rows)
    assert links > 500
    nulls = [(None, f"{passage} n{i % 500} m{i % 500} " + " ".join(f"o{i % 500}x{j}" for j in range(30))) for i in range(1000)]
    df = spark.createDataFrame(rows + nulls, "doc_id long, text string").repartition(3)
    got = jaccard.similarity_components(spark, df, slice_bytes=3000, group=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 1000


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB", 5)
    rng = random.Random(10)
    pairs = [(i, 90) for i in range(80)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    F = decontaminate.F
    df = spark.createDataFrame(pairs, "x long, y long").withColumns({"xr": F.col("x") * 10, "yr": F.col("y") * 10})
    got = jaccard.components(Scratch(spark, "t"), df.select(jaccard.node("x", "xr").alias("u"), jaccard.node("y", "yr").alias("v"))).collect()
    alone = {a for a, b in pairs if a == b} - {x for p in pairs if p[0] != p[1] for x in p}
    assert sorted((r.id, r.label, r.component_id) for r in got) == sorted((x, find(x), 10 * find(x)) for x in parent if x not in alone)


def test_jaccard_parts_cover_all_slices(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "MOST_PARTITIONS", 7)
    p = jaccard.Parts.of(10_000, 100, 2)
    assert (p.n, p.subs) == (7, 15) and jaccard.Parts.of(0, 100, 2) == jaccard.Parts(2, 1)
    keys = jaccard.mix(np.arange(1, 20_000, dtype=np.uint64))
    assert set(p.part(keys).tolist()) == set(range(7)) and set(p.sub(keys).tolist()) == set(range(15))


def test_jaccard_chunks_meet_each_other_once():
    import numpy as np

    n = 40
    pack = jaccard.Pack(np.stack((np.arange(n), *[np.ones(n, int)] * 4)), np.full(n, 77, np.uint64), np.ones(n, np.int32), [])
    tiles = jaccard.spread(pack, jaccard.Hot(np.array([77], np.uint64), np.array([4])), None)
    met = collections.Counter()
    for k in set(tiles.keys.tolist()):
        at = np.flatnonzero(tiles.keys == k)
        who, side = tiles.which()[at], tiles.marks[at] & 6
        met.update((int(a), int(b)) for a, p in zip(who, side) for b, q in zip(who, side) if a < b and (p != q or p == 0))
    assert met == collections.Counter((a, b) for a in range(n) for b in range(a + 1, n))
    assert jaccard.spread(pack, jaccard.Hot(np.array([77], np.uint64), np.array([0])), None).heads[-1].sum() == 0


def test_signatures_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 17, 33, 63, 65, 100, 130, 500, 1500):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            d = rng.integers(0, 2 * n // 7 + 1)
            gone = int(rng.integers(0, d + 1))
            y = np.concatenate((x[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)))
            both = n - gone
            if not len(y) or 4 * both < 3 * (n + len(y) - both):
                continue
            a, b = np.sort(x), np.sort(y)
            sig = lambda h: {s for _, band, most in jaccard.instances(len(h)) for s in jaccard.signatures(h, band, most)[0].tolist()}
            assert sig(a) & sig(b)


def test_parity_maps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((50, 60), (300, 250), (900, 1100)):
        x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, m))
        y[:20] = x[:20]
        p, q = jaccard.parities(x), jaccard.parities(y)
        w = min(len(p), len(q)) // 8
        assert np.bitwise_count(jaccard.folded(p, w) ^ jaccard.folded(q, w)).sum() <= n + m - 40


def test_jaccard_odd_rows_and_empty(spark, odd, none):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(spark, odd).collect())
    assert got[1, 4, 1] == 2 and got[2, 0, 2] == 1 and got[4, 0, 4] == 1 and got[None, 3, None] == 1 and got[5, 1, 5] == 1
    assert jaccard.similarity_components(spark, none).count() == 0
    kept = jaccard.keep_one(spark, odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 1


# ----------------------------------------------------------------- 6 language


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    rows = language.op6(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in language.op6(spark, odd).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[2].score == 0
    assert language.op6(spark, none).count() == 0
    assert {r.lang_pred for r in language.op6(spark, odd.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, "der die das" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(4000)], "doc_id long, text string, lang string")
    model = language.fit(rows, train_docs=400)
    assert model.score(language.features("die der und das"))[0] == "de" and model.score(language.features("the and of"))[0] == "en"


# ------------------------------------------------------------------- 7 mixing


def plain_mix(rows, alpha, budget_share):
    tokens = collections.Counter()
    for s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    z = sum((t / total) ** alpha for t in tokens.values())
    return {s: (t / total) ** alpha / z for s, t in tokens.items()}, tokens, total


def test_mixing_meets_the_limit_and_the_budget(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaaaaaaabbc"), "w " * rng.randrange(1, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    scratch = Scratch(spark, "t")
    src = mixing.source_table(df.select(mixing.source_key(df.source).alias("_s"), mixing.F.size(mixing.words(df.text)).cast("long").alias("tokens")))
    alpha, norm, budget = mixing.solve(src, mixing.Target(max_repetition=2.0))
    weights, tokens, total = plain_mix([(s, len(t.split())) for _, s, t in rows], alpha, 1)
    repeats = {s: w * total / tokens[s] for s, w in weights.items()}
    assert max(repeats.values()) == pytest.approx(2.0, abs=1e-6) and budget == total
    out = mixing.mixed(scratch, df, mixing.Target(max_repetition=2.0)).collect()
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.copies * len(r.text.split())
    for s, t in tokens.items():
        want = weights[s] * total
        assert want - 40 <= taken[s] <= want + 1
    assert len(out) == len(rows) and all(r.copies in (int(repeats[r.source]), int(repeats[r.source]) + 1) for r in out)


def test_mixing_entropy_and_cover(spark):
    import math

    src = spark.createDataFrame([("=a", 8000, 80), ("=b", 1000, 10), ("=c", 500, 5)], "_s string, tokens long, docs long")
    alpha, norm, _ = mixing.solve(src, mixing.Target(entropy=0.9))
    p = [8000 / 9500, 1000 / 9500, 500 / 9500]
    w = [x**alpha / norm for x in p]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    alpha, norm, budget = mixing.solve(src, mixing.Target(max_repetition=1.5, budget="cover"))
    assert (16) ** (1 - alpha) == pytest.approx(1.5, abs=1e-6)
    assert p[0] ** alpha / norm * budget == pytest.approx(8000, abs=1)


def test_mixing_odd_rows_and_blocks(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    out = mixing.mixed(Scratch(spark, "t"), odd, mixing.Target(max_repetition=1.5, budget="cover"), copies="times")
    assert out.count() == len(ODD) and all(r["times"] >= 0 for r in out.collect())
    assert mixing.op7(spark, none).count() == 0
    rows = [(i, "s" if i % 10 else "r", "w " * (1 + i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(Scratch(spark, "t"), df, mixing.Target(max_repetition=2.0))
    assert got.count() == 500 and got.agg({"copies": "max"}).first()[0] <= 2


# -------------------------------------------------------------------- 8 lines


def test_line_windows_odd_rows(spark, odd, none):
    r = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (5, "a\nb"), (1, "a\nb\nc\nd"), (6, "\n\n\n\n"), (7, "q q\nb\nc\nq q\nb\nc\nq q\nb\nc")], "doc_id long, text string")
    got = collections.Counter((x.doc_id, x.clean, x.n_removed) for x in lines.dedup_lines(Scratch(spark, "t"), r).collect())
    assert got == collections.Counter({(1, "a\nb\nc\nd", 0): 2, (2, "x", 3): 1, (3, None, 0): 1, (4, "", 0): 1, (5, "a\nb", 0): 1, (6, "\n\n\n\n", 0): 1, (7, "q q\nb\nc", 6): 1})
    assert lines.op8(spark, none).count() == 0 and lines.op8(spark, odd).count() == len(ODD)


# ---------------------------------------------------------------- 9 benchmark


def leaks_by_brute_force(docs, bench):
    out = {}
    for k, text in docs:
        w = text.lower().split()
        for i, t in bench:
            v = t.lower().split()
            n = len(v)
            it = collections.Counter(tuple(v[j : j + 5]) for j in range(n - 4))
            best = None
            for a in range(len(w) - n + 1):
                c = collections.Counter(tuple(w[j : j + 5]) for j in range(a, a + n - 4))
                low = sum((c & it).values())
                if 4 * low >= 3 * (2 * (n - 4) - low) and (best is None or low > best[1]):
                    best = (a, low, 2 * (n - 4) - low)
            if best:
                out[k, i] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    texts = [r.text for r in table(spark, SF, "documents").limit(80).collect()]
    docs = []
    for k, text in enumerate(texts):
        w = rng.choice(bench)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p, o = rng.randrange(len(w)), rng.random()
            if o < 0.4:
                w[p] = "xx"
            elif o < 0.7:
                w.insert(p, "yy")
            else:
                del w[p]
        x = text.split(" ")[:150]
        p = rng.randrange(len(x) + 1)
        docs.append((k, " ".join(x[:p] + w + x[p:]) if k % 4 else " ".join(x)))
    want = leaks_by_brute_force(docs, bench)
    got = decontaminate.op9(spark, spark.createDataFrame(docs, "doc_id long, text string"), table(spark, SF, "benchmark")).collect()
    assert {(r.doc_id, r.item_id): (r.start_word, r.shared_weight, r.total_weight) for r in got} == want and len(want) > 20


def test_leaks_in_texts_shorter_than_the_item(spark):
    item = [f"q{i}" for i in range(45)]
    texts = {
        1: item[:20] + item[21:],  # an inner word less
        2: item[:35], 3: item[10:],  # cut to 31 of 41 shingles
        4: item[:34], 5: item[11:],  # to 30: under the threshold
        6: item[:4], 7: ["zz", *item[:40]], 8: item,
    }
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], DOC.split(", lang")[0])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:30]))], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.shared_weight, r.total_weight) for r in decontaminate.op9(spark, docs, bench).collect() if r.item_id == 1}
    assert got == {1: (0, 36, 45), 2: (0, 31, 41), 3: (0, 31, 41), 7: (0, 36, 42), 8: (0, 41, 41)}
    assert {r.doc_id for r in decontaminate.clean(spark, docs, bench.filter("item_id = 1")).collect()} == {4, 5, 6}


def test_leaks_beyond_the_radius(spark):
    """A similar text far off by fingerprint: up to 1/7 of an item's places give way to one repeated word."""
    items = [[f"r{k}x{i}" for i in range(60)] for k in range(40)]
    texts = [w[:52] + ["pad"] * 8 if k % 2 else ["pad"] * 8 + w[8:] for k, w in enumerate(items)]
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{key} long, text string")
    got = decontaminate.find_leaks(spark, Scratch(spark, "t"), frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.low, r.high) for r in got) == [(k, k, 0, 48, 64) for k in range(40)]
    assert any(r.distance > decontaminate.RADIUS for r in got) and any(r.distance <= decontaminate.RADIUS for r in got)


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "A b c D e f g h"), (2, None), (3, ""), (4, "x y z"), (5, "w " * 20)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9(spark, odd, bench).collect()}
    assert got == {(1, 1), (5, 5)}
    assert decontaminate.op9(spark, none, bench).count() == 0 and decontaminate.op9(spark, odd, bench.limit(0)).count() == 0
    clean = decontaminate.clean(spark, odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 3


def test_bit_table_never_misses(spark):
    from helixion.llm.common import bit_table, in_bits

    F = decontaminate.F
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = bit_table(df, F.col("h")).scalar()
    assert df.filter(~in_bits(bits, F.col("h"))).count() == 0
    assert spark.range(10_000, 20_000).filter(in_bits(bits, F.xxhash64("id"))).count() < 20


# ----------------------------------------------------------------- 10 shards


def test_shards_by_brute_force(spark, odd, none):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    rows = sorted((r.doc_id, len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs)
    total, before, want, slots = sum(r[1] for r in rows), 0, [], collections.Counter()
    for i, n, c in rows:
        s = min(23, (2 * before + n) * 24 // (2 * total))
        want.append((i, n, c, "bytes", s, slots[s], None))
        slots[s] += 1
        before += n
    got = shards.byte_shards(spark, table(spark, SF, "documents")).collect()
    assert sorted(map(tuple, got)) == want
    sized = collections.Counter()
    for r in want:
        sized[r[4]] += r[1]
    assert max(abs(b - total / 24) for b in sized.values()) <= max(r[1] for r in rows)
    out = shards.byte_shards(spark, odd).collect()
    assert len(out) == len(ODD) and [r.size for r in out if r.doc_id == 2] == [8] and sorted(r.slot for r in out if r.shard == out[0].shard) == list(range(sum(r.shard == out[0].shard for r in out)))
    assert shards.byte_shards(spark, none).count() == 0


# ------------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r for r in quality.op1(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect()}
    comp, _ = components_by_brute_force(sorted((i, texts[i]) for i in kept))
    kept = sorted(i for i in kept if comp[i][1] == i)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    seeds = {tuple(w[j : j + 5]) for _, t in bench for w in [t.lower().split()] for j in range(len(w) - 4)}
    near = [i for i in kept if any(tuple(w[j : j + 5]) in seeds for w in [texts[i].lower().split()] for j in range(len(w) - 4))]
    leaking = {k for k, _ in leaks_by_brute_force([(i, texts[i]) for i in near], bench)}
    kept = [i for i in kept if i not in leaking]
    out = cp.run(spark, SF).collect()
    copies = collections.Counter(r.doc_id for r in out)
    assert set(copies) == set(kept) and max(copies.values()) <= 2
    total = sum(r.size for r in out)
    sizes = collections.Counter()
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 8
        sizes[r.shard] += r.size
    assert max(abs(b - total / 24) for b in sizes.values()) <= max(r.size for r in out)
    assert len(cp.STAGES) == 5


def test_pipeline_stages_keep_the_columns(spark, odd):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
