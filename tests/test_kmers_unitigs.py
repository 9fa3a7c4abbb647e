import random
import time
from collections import Counter

import pytest

from helixion.operators import kmers as G
from helixion.operators import spectrum as S
from helixion.operators import unitigs as U
from helixion.sources import unitig_fasta

READS = ["ACGGTCATTGCA", "GGTCATTGCACC", "TCATTGCACCGA", "ACGGTCATAGCA", "GGTCATAGCACC", "GGTGCAATGACC", "TCATAGCACCGA"]
SPECTRUM = {
    "AATGA": 4, "ATTGC": 4, "GGTCA": 5, "ACCGA": 2, "CAATG": 4, "GTGCA": 3, "ACCGT": 2, "CACCG": 2, "TAGCA": 3,
    "AGCAC": 2, "CATAG": 3, "TATGA": 3, "ATAGC": 3, "CGGTC": 2, "TGCAA": 4, "ATGAC": 5, "GCACC": 5,
}
UNITIGS = [("ACCGA", 2), ("ACCGT", 2), ("ATGACCG", 5), ("CGGTGC", 3), ("GTGCA", 3), ("GTGCTATGA", 3), ("TCATTGCA", 4)]
LINKS = ["L:-:3:+ L:-:2:-", "L:-:3:+ L:-:2:-", "L:+:0:+ L:+:1:+ L:-:6:+ L:-:5:-", "L:+:4:+ L:+:5:+ L:-:1:+ L:-:0:+", "L:+:6:- L:+:4:- L:-:3:-", "L:+:2:+ L:-:3:-", "L:+:6:- L:+:4:- L:-:2:+"]


def reads(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def counts(spark, seqs, k):
    return S.count(G.canonical_kmers(reads(spark, seqs), k))


def test_golden_spectrum_and_unitigs(spark, tmp_path):
    sp = counts(spark, READS, 5)
    assert {r.kmer: r.cnt for r in sp.collect()} == SPECTRUM
    u = U.unitigs(sp, 5)
    assert [(r.seq, r.median_abundance) for r in u.orderBy("unitig_id").collect()] == UNITIGS
    text = [r.value for r in unitig_fasta.to_fasta(u, 5).orderBy("unitig_id").collect()]
    assert [t.split("\n")[0].split(" ", 4)[4] for t in text] == LINKS
    assert text[2].startswith(">2 LN:i:7 KC:i:15 km:f:5 ")
    unitig_fasta.write(u, 5, str(tmp_path / "u"))
    again = unitig_fasta.load(spark, str(tmp_path / "u"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, u.collect()))
    nodes = {r.unitig_id: (r.after_nodes, r.before_nodes) for r in U.graph_nodes(u, 5).collect()}
    assert nodes[2] == ([1, 2], [7, -6])
    assert U.connected(u, 5, 0, 2, 100) and not U.connected(u, 5, 0, 6, 0)


@pytest.mark.parametrize(
    "read, incoming, strict",
    [
        ("ACGTNACGTA", "ACGT ACGT CGTA", "ACGT ACGT CGTA"),
        ("ACGNTACGT", "ACGN CGNT GNTA NTAC TACG ACGT", "TACG ACGT"),
        ("NNACGTA", "NNAC NACG ACGT CGTA", "ACGT CGTA"),
        ("ACGTANNCGTACG", "ACGT CGTA NCGT CGTA GTAC TACG", "ACGT CGTA CGTA GTAC TACG"),
        ("ACG", "", ""),
    ],
)
def test_n_policies(spark, read, incoming, strict):
    for policy, want in (("incoming", incoming), ("strict", strict)):
        got = [r.kmer for r in G.canonical_kmers(reads(spark, [read]), 4, n_policy=policy, canonical=False).collect()]
        assert got == want.split()


def plain_incoming(seq, k):
    """Windows under the incoming-N rule, restart by restart."""
    out, at = [], 0
    while at + k <= len(seq):
        end = seq.find("N", at + k)
        end = len(seq) if end < 0 else end
        out += [seq[i : i + k] for i in range(at, end - k + 1)]
        at = end + 1
    return out


def test_incoming_n_on_long_reads(spark):
    """Many restarts in a read: the work is linear in its length, and the windows are those of a plain version."""
    rng = random.Random(7)
    some = ["".join(rng.choice("ACGTNacgtn") for _ in range(n)) for n in (0, 3, 4, 40, 400)] + ["N" * 30, None]
    long = "".join(rng.choice("ACGTN" if i % 3 else "ACGT") for i in range(40_000))
    G.canonical_kmers(reads(spark, some), 4, n_policy="incoming").count()  # the code is compiled
    began = time.time()
    for k, seqs in ((4, some), (11, [long])):
        got = Counter(r.kmer for r in G.canonical_kmers(reads(spark, seqs), k, n_policy="incoming").collect())
        raw = Counter(w.upper() for s in seqs for w in plain_incoming(s or "", k))
        want = Counter()
        for w, n in raw.items():
            want[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += n
        assert got == want
        assert [r.kmer for r in G.canonical_kmers(reads(spark, seqs), k, n_policy="incoming", canonical=False).collect()] == [w for s in seqs for w in plain_incoming(s or "", k)]
    assert time.time() - began < 20


def test_positioned_codes_fill_over_n(spark):
    rows = G.positioned_codes(reads(spark, ["ACGNACG"]), 3, 16).collect()
    plus = sorted((r.pos, r.code) for r in rows if r.strand == "+")
    assert plus == [(0, 6), (1, 6), (2, 6), (3, 6), (4, 6)]
    with pytest.raises(ValueError):
        G.positioned_codes(reads(spark, ["A"]), 17, 16)


def plain_unitigs(spectrum, k, s):
    """Unitigs walked one by one over a dictionary."""
    nodes = {x for m, c in spectrum.items() if c >= s for x in (m, rc(m))}
    nxt = lambda u: [u[1:] + b for b in "ACGT" if u[1:] + b in nodes]
    prv = lambda u: [b + u[:-1] for b in "ACGT" if b + u[:-1] in nodes]
    inner = lambda u: (n := nxt(u)) and len(n) == 1 and len(prv(n[0])) == 1 and n[0] or None
    into = {v: u for u in nodes if (v := inner(u))}
    out, seen = set(), set()
    for u in nodes:
        if u not in into:
            path = [u]
            while v := inner(path[-1]):
                path.append(v)
            seen.update(path)
            seq = path[0] + "".join(p[-1] for p in path[1:])
            out.add(min(seq, rc(seq)))
    for u in sorted(nodes - seen):
        if u in seen:
            continue
        path = [u]
        while (v := inner(path[-1])) != u:
            path.append(v)
        other = min(rc(p) for p in path)
        seen.update(path)
        seen.update(rc(p) for p in path)
        if other < u:
            i = next(i for i, p in enumerate(path) if rc(p) == other)
            path = [rc(p) for p in (path[i::-1] + path[:i:-1])]
        out.add(path[0] + "".join(p[-1] for p in path[1:]))
    return out


@pytest.mark.parametrize("k, seed", [(5, 1), (4, 2), (7, 3), (6, 4)])
def test_unitigs_against_a_walk(spark, k, seed):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(150))
    cycle = "".join(rng.choice("ACGT") for _ in range(30))
    seqs = [genome[i : i + 40] for i in range(0, 120, 5)] + [cycle + cycle[: k - 1]] * 2 + [genome[:20] + rc(genome[:20])] * 2 + ["A" * 12] * 2
    sp = Counter(min(w, rc(w)) for s in seqs for i in range(len(s) - k + 1) for w in [s[i : i + k]])
    got = U.unitigs(counts(spark, seqs, k), k).collect()
    assert {r.seq for r in got} == plain_unitigs(sp, k, 2)
    assert [r.unitig_id for r in sorted(got, key=lambda r: r.seq)] == list(range(len(got)))


def test_pure_cycle_and_missing_seed(spark):
    cycle = "ACGATTGCCA"
    u = U.unitigs(counts(spark, [cycle + cycle[:4]] * 3, 5), 5).collect()
    assert len(u) == 1 and u[0].len == len(cycle) + 4
    two = counts(spark, [cycle + cycle[:4]] * 3 + ["CTCTCAGAGTAC"] * 6, 5)
    assert U.unitigs(two, 5, seed_min=5).count() < U.unitigs(two, 5, seed_min=5, seeded=False).count()


def test_empty_input(spark):
    sp = counts(spark, ["NNNN", "AC", None], 5)
    assert sp.count() == 0 and U.unitigs(sp, 5).count() == 0
    assert S.magnitude(sp).first().magnitude == 0 and S.inner_product(sp, sp).first().dot == 0


def test_spectrum_algebra_properties(spark):
    a, b = counts(spark, READS[:4], 5), counts(spark, READS[3:], 5)
    as_dict = lambda d: {r.kmer: r.cnt for r in d.collect()}
    assert as_dict(S.merge(a, b)) == as_dict(S.merge(b, a))
    assert as_dict(S.remove(S.merge(a, b), b)) == as_dict(a)
    x, y = as_dict(a), as_dict(b)
    assert S.inner_product(a, b).first().dot == sum(v * y.get(k, 0) for k, v in x.items())
    assert as_dict(S.intersect(a, b, counts="min")) == {k: min(v, y[k]) for k, v in x.items() if k in y}
    assert sum(as_dict(counts(spark, READS, 5)).values()) == sum(len(r) - 4 for r in READS)
