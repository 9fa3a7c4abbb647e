"""Registered queries over the provided tables, with their DuckDB texts.

Sequences are the letters a, c, g and t of the documents' texts, upper-cased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixion.functions import dna, hashing, stats
from helixion.operators import kmers as G
from helixion.operators import similarity as J
from helixion.operators import spectrum as S
from helixion.operators import unitigs as U
from helixion.plans import planner
from helixion.plans.lineage import Tables
from helixion.plans.ship import ship
from helixion.sources import reads as R
from helixion.sources import spectrum_store, unitig_fasta
from helixion.streaming.denoise import Denoiser, run_batches

Query = Callable[[SparkSession, str], DataFrame]
K, K_GRAPH, HB = 11, 15, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, letters: str = "acgt") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "lang", F.upper(F.regexp_replace(F.lower("text"), f"[^{letters}]", "")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))


def spectrum(r: DataFrame, k: int = K) -> DataFrame:
    return S.count(G.canonical_kmers(r, k))


def halves(s: SparkSession, d: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The spectra of English reads and of all others."""
    r = reads(s, d)
    return spectrum(r.filter("lang <=> 'en'"), k), spectrum(r.filter("NOT lang <=> 'en'"), k)


def half_kmers(s: SparkSession, d: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The k-mers of both, uncounted, for operators that group both sides at once."""
    km = lambda cond: G.canonical_kmers(reads(s, d).filter(cond), k).withColumn("cnt", F.lit(1).cast("long"))
    return km("lang <=> 'en'"), km("NOT lang <=> 'en'")


# --------------------------------------------------------------- SQL pieces

READS = "reads AS (SELECT doc_id AS read_id, lang, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq FROM documents)"
ITEMS = "items AS (SELECT item_id, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq FROM benchmark)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def windows(k: int, of: str = "reads", key: str = "read_id, lang", name: str = "km") -> str:
    return f"{name} AS (SELECT {key}, i - 1 AS pos, substr(seq, i, {k}) AS w FROM (SELECT {key}, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM {of}))"


def counted(where: str = "true", name: str = "sp") -> str:
    return f"{name} AS (SELECT least(w, {rc('w')}) AS kmer, count(*) AS cnt FROM km WHERE {where} GROUP BY 1)"


def hash_sql(w: str, k: int, reverse: bool = False) -> str:
    """The rolling hash of a k-mer as UHUGEINT, base by base from rotated seeds; other letters count as nothing."""
    pairs = dict(zip("ACGT", "TGCA", strict=True))
    turn = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & hashing.MASK
    term = lambda i: " ".join(f"WHEN '{b}' THEN {turn(hashing.SEEDS[pairs[b] if reverse else b], i if reverse else k - 1 - i)}" for b in "ACGT")
    out = "0::UHUGEINT"
    for i in range(k):
        out = f"xor({out}, (CASE substr({w}, {i + 1}, 1) {term(i)} ELSE 0 END)::UHUGEINT)"
    return out


def signed_sql(x: str) -> str:
    return f"(CASE WHEN ({x})::HUGEINT >= {1 << 63} THEN ({x})::HUGEINT - {1 << 64} ELSE ({x})::HUGEINT END)::BIGINT"


def seeded_sql(x: str, k: int, i: int) -> str:
    by = i ^ (k * hashing.MULTI_SEED & hashing.MASK)
    y = f"(({x})::UHUGEINT * {by}::UHUGEINT % {1 << 64}::UHUGEINT)"
    return f"xor({y}, {y} // {1 << hashing.MULTI_SHIFT}::UHUGEINT)"


def murmur_sql(w: str, k: int) -> str:
    """MurmurHash2 of a string of k one-byte letters, word by word."""
    m, low = hashing.MURMUR_M, 0xFFFFFFFF
    byte = lambda i: f"ascii(substr({w}, {i + 1}, 1))::HUGEINT"
    word = lambda a, n: "(" + " + ".join(f"{byte(a + j)} * {1 << 8 * j}" for j in range(n)) + ")"
    h, steps = f"{k}::HUGEINT", []
    for a in range(0, k // 4 * 4, 4):
        steps.append(f"(list_transform([{word(a, 4)} * {m} % {low + 1}], lambda x: xor(x, x // {1 << hashing.MURMUR_R}) * {m} % {low + 1})[1])")
    for x in steps:
        h = f"xor({h} * {m} % {low + 1}, {x})"
    if k % 4:
        h = f"(xor({h}, {word(k // 4 * 4, k % 4)}) * {m} % {low + 1})"
    return f"list_transform([list_transform([{h}], lambda x: xor(x, x // 8192) * {m} % {low + 1})[1]], lambda x: xor(x, x // 32768))[1]"


#: The batches, trigger and rounds of the streamed count.
BATCHES, TRIGGER, ROUNDS = 5, 20_000, 2


def _denoise_sql() -> str:
    """Batch after batch: merge, and while rounds are left and the state is large enough, drop what was seen once."""
    out = [f"WITH {READS}, {windows(K)}", f"c AS (SELECT read_id % {BATCHES} AS b, least(w, {rc('w')}) AS kmer, count(*) AS cnt FROM km GROUP BY 1, 2)", "s0 AS (SELECT ''::VARCHAR AS kmer, 0::BIGINT AS cnt WHERE false)", "u0 AS (SELECT 0 AS used)"]
    for i in range(BATCHES):
        out.append(f"m{i} AS MATERIALIZED (SELECT kmer, sum(cnt)::BIGINT AS cnt FROM (FROM s{i} UNION ALL SELECT kmer, cnt FROM c WHERE b = {i}) GROUP BY 1)")
        out.append(f"u{i + 1} AS MATERIALIZED (SELECT used + (used < {ROUNDS} AND (SELECT count(*) FROM m{i}) >= {TRIGGER})::INT AS used FROM u{i})")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT kmer, cnt FROM m{i}, u{i}, u{i + 1} WHERE cnt > 1 OR u{i}.used = u{i + 1}.used)")
    return ", ".join(out) + f" SELECT kmer, cnt FROM s{BATCHES} WHERE cnt > 1"


def on_spectrum(select: str, k: int = K) -> str:
    return f"WITH {READS}, {windows(k)}, {counted()} {select}"


def on_halves(select: str) -> str:
    return f"WITH {READS}, {windows(K)}, {counted("lang IS NOT DISTINCT FROM 'en'", 'a')}, {counted("lang IS DISTINCT FROM 'en'", 'b')} {select}"


#: Both strands of solid k-mers, inner links, chains walked from their heads, and cycles from their least k-mers.
UNITIGS = f"""WITH RECURSIVE {READS}, {windows(K_GRAPH)}, {counted()},
nodes AS (SELECT kmer AS node, cnt FROM sp WHERE cnt >= 2 UNION SELECT {rc('kmer')}, cnt FROM sp WHERE cnt >= 2),
o AS (SELECT left(node, {K_GRAPH - 1}) AS m, count(*) AS n, min(node) AS node FROM nodes GROUP BY 1),
i AS (SELECT right(node, {K_GRAPH - 1}) AS m, count(*) AS n, min(node) AS node FROM nodes GROUP BY 1),
ln AS (SELECT i.node AS prev, o.node AS node FROM o JOIN i USING (m) WHERE o.n = 1 AND i.n = 1),
walk AS (
  SELECT node AS head, node, 0 AS dist FROM nodes WHERE node NOT IN (SELECT node FROM ln)
  UNION ALL SELECT head, ln.node, dist + 1 FROM walk JOIN ln ON ln.prev = walk.node
),
rest AS (SELECT node FROM ln WHERE node NOT IN (SELECT node FROM walk)),
loop AS (SELECT node AS head, node, 0 AS dist FROM rest UNION ALL SELECT head, ln.node, dist + 1 FROM loop JOIN ln ON ln.prev = loop.node WHERE ln.node <> head),
low AS (SELECT head FROM loop GROUP BY head HAVING min(node) = head AND head <= min({rc('node')})),
every AS (SELECT head, node, dist, false AS cycle FROM walk UNION ALL SELECT head, node, dist, true FROM loop WHERE head IN (SELECT head FROM low)),
grown AS (
  SELECT cycle, left(head, {K_GRAPH - 1}) || string_agg(right(every.node, 1), '' ORDER BY dist) AS seq, floor(median(cnt))::INT AS median_abundance
  FROM every JOIN nodes ON nodes.node = every.node GROUP BY head, cycle
),
u AS (
  SELECT row_number() OVER (ORDER BY seq) - 1 AS unitig_id, seq, length(seq)::INT AS len, median_abundance
  FROM (SELECT DISTINCT CASE WHEN cycle THEN seq ELSE least(seq, {rc('seq')}) END AS seq, median_abundance FROM grown)
),
ends AS (
  SELECT left(seq, {K_GRAPH}) AS end_kmer, unitig_id, 1 AS sign FROM u
  UNION ALL SELECT {rc(f'right(seq, {K_GRAPH})')}, unitig_id, -1 FROM u WHERE left(seq, {K_GRAPH}) <> {rc(f'right(seq, {K_GRAPH})')}
),
outs AS (
  SELECT unitig_id AS src, 1 AS src_sign, right(seq, {K_GRAPH - 1}) AS m FROM u
  UNION ALL SELECT unitig_id, -1, {rc(f'left(seq, {K_GRAPH - 1})')} FROM u
),
lk AS (SELECT src, src_sign, unitig_id AS dst, sign AS dst_sign, right(end_kmer, 1) AS base FROM outs JOIN ends ON left(end_kmer, {K_GRAPH - 1}) = m)
"""


def graph(s: SparkSession, d: str) -> DataFrame:
    return U.unitigs(spectrum(reads(s, d), K_GRAPH), K_GRAPH)


def _links(s: SparkSession, d: str) -> DataFrame:
    return U.links(graph(s, d), K_GRAPH)


def _reloaded(s: SparkSession, d: str) -> DataFrame:
    """The graph's FASTA text parsed again, as a file's would be."""
    text = unitig_fasta.to_fasta(graph(s, d), K_GRAPH)
    head, seq = F.substring_index("value", "\n", 1), F.substring_index("value", "\n", -1)
    return text.select("unitig_id", dna.header_field(head, "LN:i").cast("long").alias("len"), dna.header_field(head, "KC:i").cast("long").alias("kmers"), dna.header_field(head, "km:f").cast("long").alias("median"), seq.alias("seq"))


def _fastq(s: SparkSession, d: str) -> DataFrame:
    """The reads written as FASTQ files and read back, beside a path that doesn't exist."""
    path = Tables(s, "fastq").path()
    record = F.concat(F.lit("@"), F.coalesce(F.col("read_id").cast("string"), F.lit("")), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    reads(s, d).select(record.alias("value")).write.text(path)
    return R.fastq_records(s, [path, f"{path}-missing"], skip_missing=True).groupBy("seq").agg(F.count("*").alias("n"))


def _fasta(s: SparkSession, d: str) -> DataFrame:
    """The reads written as FASTA files, wrapped at 60 bases, and read back."""
    path = Tables(s, "fasta").path()
    record = F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" doc\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    reads(s, d).select(record.alias("value")).write.text(path)
    return R.fasta(s, [path]).select("header", "seq")


def _saved(s: SparkSession, d: str) -> DataFrame:
    path = Tables(s, "saved").path()
    spectrum_store.save(spectrum(reads(s, d)), path, K)
    return spectrum_store.load(s, path, K)


def _end_index(s: SparkSession, d: str) -> DataFrame:
    """The end index of the graph's FASTA file, as read back."""
    path = Tables(s, "unitig-fasta").path()
    unitig_fasta.write(graph(s, d), K_GRAPH, path)
    return unitig_fasta.load_with_ends(s, path, K_GRAPH)[1].select("end_kmer", "unitig_id", "sign")


def _scalars(s: SparkSession, d: str) -> DataFrame:
    r = reads(s, d)
    c = F.col("seq")
    return r.select(
        "read_id",
        dna.reverse_complement(c).alias("revcomp"), dna.n_bases(c).alias("n_bases"), dna.packed_bytes(c).alias("n_bytes"),
        dna.subsequence(c, 3, 7).alias("sub"), dna.base_at(c, 2).alias("third"), dna.drop_first(c).alias("popped"),
        dna.append_base(c, "G").alias("appended"), dna.prepend_base("T", c).alias("prepended"), dna.to_lower(c).alias("lower"),
        dna.replace_base(c, 1, "T").alias("replaced"), dna.complement_base(F.left(c, F.lit(1))).alias("first_complement"),
    )


def _flags(s: SparkSession, d: str) -> DataFrame:
    km = G.canonical_kmers(reads(s, d), 8, canonical=False).distinct()
    return km.select("kmer", dna.is_palindrome("kmer").alias("palindrome"), dna.is_hairpin("kmer", 3).alias("hairpin"), dna.is_homopolymer("kmer").alias("simple"), dna.canonical("kmer").alias("canon"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    km = G.canonical_kmers(reads(s, d), 9, canonical=False).distinct()
    code = dna.encode("kmer")
    return km.select("kmer", code.alias("code"), dna.decode(code, 9).alias("back"), dna.reverse_complement_code(code, 9).alias("rc_code"))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    km = G.canonical_kmers(reads(s, d), 7).distinct()
    return km.select("kmer", F.array_join(dna.kmers_before("kmer"), ",").alias("before"), F.array_join(dna.kmers_after("kmer", "ATGC"), ",").alias("after"))


def _positioned(s: SparkSession, d: str) -> DataFrame:
    return G.positioned_codes(items(s, d), 16, key="item_id")


def _lookup(s: SparkSession, d: str) -> DataFrame:
    a, b = halves(s, d)
    return S.lookup(a, b.select("kmer"))


def _remove(s: SparkSession, d: str) -> DataFrame:
    return S.remove(*halves(s, d))


def _replace(s: SparkSession, d: str) -> DataFrame:
    return S.replace(*halves(s, d))


def _recipe(s: SparkSession, d: str) -> DataFrame:
    m = S.moments(spectrum(reads(s, d)))
    e = 1 - F.pow((F.col("f1_total") - F.col("f1") - 2 * F.col("f2")) / F.col("f1_total"), F.lit(1 / K))
    return m.select((F.col("f0") - F.col("f1") - F.col("f2")).alias("n_true"), F.round(e, 6).alias("error"))


def _summary(s: SparkSession, d: str) -> DataFrame:
    return stats.contig_summary(table(s, d, "documents").select(F.length("text").cast("long").alias("len")), 1_000_000)


def _ngx(s: SparkSession, d: str) -> DataFrame:
    return stats.ngx(table(s, d, "documents").select(F.length("text").cast("long").alias("len")), 75, 2_000_000)


def _vector(s: SparkSession, d: str) -> DataFrame:
    q, p = "l_quantity", "l_extendedprice"
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(stats.mean(q), 6).alias("mean_q"), F.round(stats.sum_sq_dev(q), 2).alias("sq_dev_q"), F.round(stats.median(q), 6).alias("median_q"), F.round(stats.pearson(q, p), 6).alias("pearson_qp"), F.round(F.sum(F.col(q) * F.col("l_linenumber")), 2).alias("dot_qn")
    )


def _sets(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring benchmark items as sets of 4-mers."""
    a = items(s, d).select("item_id", F.array_distinct(G.forward_windows(F.col("seq"), 4)).alias("x"))
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("x").alias("y"))
    return a.join(b, "item_id").select("item_id", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.round(stats.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(stats.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


def _sketches(s: SparkSession, d: str) -> DataFrame:
    a = items(s, d).select("item_id", hashing.minhash_sketch(F.transform(G.forward_windows(F.col("seq"), 8), lambda w: dna.encode(w)), 16).alias("x"))
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("x").alias("y"))
    return a.join(b, "item_id").select("item_id", F.round(stats.sketch_jaccard(F.col("x"), F.col("y"), 16), 6).alias("jaccard"))


def _bits(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.round(stats.jaccard_bits(F.col("o_orderkey") + 1, F.col("o_custkey") + 1), 6).alias("jaccard"))


def _pairs(f: Callable[..., DataFrame], *more) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        left = J.placed(reads(s, d), K, "read_id")
        return f(left, J.placed(items(s, d), K, "item_id"), "read_id", "item_id", *more)

    return run


def _runs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(J.shared_runs, 5)(s, d).withColumn("ratio", F.round("ratio", 6))


def _tandem(s: SparkSession, d: str) -> DataFrame:
    return J.is_tandem_repeat(reads(s, d), "read_id")


def _same(s: SparkSession, d: str) -> DataFrame:
    return J.same_sequence(reads(s, d), "read_id")


def _fingerprints(s: SparkSession, d: str) -> DataFrame:
    return S.count(hashing.hash_reads(reads(s, d), K, HB), "key")


def _hashes(s: SparkSession, d: str) -> DataFrame:
    km = G.canonical_kmers(reads(s, d), K, canonical=False).distinct()
    return km.select(
        "kmer", hashing.forward_hash("kmer").alias("forward"), hashing.reverse_hash("kmer").alias("reverse"), hashing.canonical_hash("kmer").alias("canonical"), hashing.murmur2_udf("kmer").alias("murmur"),
        hashing.seeded_hash("kmer", 7, canonical=False).alias("seeded_forward"), hashing.seeded_hash("kmer", 7).alias("seeded"),
    )


def _multi(s: SparkSession, d: str) -> DataFrame:
    km = reads(s, d, "acgtn").select(F.explode(G.forward_windows(F.col("seq"), K)).alias("kmer")).distinct()
    return hashing.hash_table(km, 3).select("kmer", *[F.get("h", F.lit(i)).alias(f"h{i}") for i in range(3)], "valid", "loc_n", F.col("hash").alias("checked"))


def _align(s: SparkSession, d: str) -> DataFrame:
    a = items(s, d)
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("seq").alias("other"))
    return a.join(b, "item_id").select("item_id", J.semi_global_align("seq", "other").alias("score"))


def _incoming_n(s: SparkSession, d: str) -> DataFrame:
    return S.count(G.canonical_kmers(reads(s, d, "acgtn"), K, n_policy="incoming"))


def _rounds(s: SparkSession, d: str) -> DataFrame:
    """The streamed count: batches of reads, removal rounds by trigger, and one at the end."""
    state = Tables(s, "denoise")
    den = Denoiser(s, f"{state.root}/state", TRIGGER, ROUNDS, end_denoise=True)
    r = reads(s, d)
    batches = [r.filter(F.pmod(F.coalesce("read_id", F.lit(0)), F.lit(BATCHES)) == i) for i in range(BATCHES)]
    return run_batches(den, [G.canonical_kmers(b, K) for b in batches])


def _murmurs(s: SparkSession, d: str) -> DataFrame:
    h = hashing.kmer_murmurs(reads(s, d), K)
    return h.select("read_id", F.size("hashes").cast("long").alias("n"), F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("hashes").alias("least"))


def _classify(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d)
    r = reads(s, d).filter(f"length(seq) >= {K_GRAPH}").select("read_id", "seq")
    return J.classify_contigs(r, U.ends(g, K_GRAPH), K_GRAPH).groupBy("known_ends").agg(F.count("*").alias("n"))


def _seed(rule: str) -> Query:
    return lambda s, d: S.count(G.mid_read_seeds(reads(s, d), K, rule))


def _model(s: SparkSession, d: str) -> DataFrame:
    """Expected error-free windows of an error profile, on the driver, as a row a k."""
    profile = [0.01 + 0.0002 * i for i in range(100)]
    return s.createDataFrame([(k, round(planner.true_windows(profile, k), 6)) for k in (11, 21, 31)], "k int, windows double")


def _argsort(s: SparkSession, d: str) -> DataFrame:
    return stats.argsort(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


QUERIES: dict[str, Query] = {
    "kmer_spectrum": lambda s, d: S.denoise(spectrum(reads(s, d))),
    "kmer_count": lambda s, d: spectrum(reads(s, d)),
    "kmer_count_long": lambda s, d: spectrum(reads(s, d), 31),
    "kmer_count_incoming_n": _incoming_n,
    "kmer_fingerprints": _fingerprints,
    "kmer_positions": _positioned,
    "seeds_center": _seed("center"),
    "seeds_half": _seed("half"),
    "dna_scalars": _scalars,
    "dna_flags": _flags,
    "dna_codes": _codes,
    "dna_neighbours": _neighbours,
    "hash_kmers": _hashes,
    "hash_multi": _multi,
    "kmer_murmurs": _murmurs,
    "spectrum_solid": lambda s, d: S.solid(spectrum(reads(s, d)), 3, 50),
    "spectrum_metadata": lambda s, d: S.metadata(spectrum(reads(s, d))),
    "spectrum_histogram": lambda s, d: S.histogram(spectrum(reads(s, d))),
    "spectrum_moments": lambda s, d: S.moments(spectrum(reads(s, d))),
    "spectrum_scan": lambda s, d: S.scan(spectrum(reads(s, d)), "G"),
    "spectrum_merge": lambda s, d: S.merge(*half_kmers(s, d)),
    "spectrum_intersect": lambda s, d: S.intersect(*half_kmers(s, d)),
    "spectrum_intersect_min": lambda s, d: S.intersect(*half_kmers(s, d), counts="min"),
    "spectrum_inner_product": lambda s, d: S.inner_product(*half_kmers(s, d)),
    "spectrum_magnitude": lambda s, d: S.magnitude(spectrum(reads(s, d))),
    "spectrum_cosine": lambda s, d: S.cosine(*half_kmers(s, d)).select(F.round("cosine", 6).alias("cosine")),
    "spectrum_lookup": _lookup,
    "spectrum_remove": _remove,
    "spectrum_delete": lambda s, d: S.delete(*halves(s, d)),
    "spectrum_replace": _replace,
    "denoise_rounds": _rounds,
    "planner_recipe": _recipe,
    "planner_error_profile": _model,
    "unitigs": graph,
    "unitig_links": _links,
    "unitig_totals": lambda s, d: U.totals(graph(s, d)),
    "unitig_ends": lambda s, d: U.ends(graph(s, d), K_GRAPH),
    "unitig_fasta": _reloaded,
    "unitig_text": lambda s, d: unitig_fasta.to_fasta(graph(s, d), K_GRAPH),
    "unitig_end_index": _end_index,
    "fastq_reads": _fastq,
    "fasta_records": _fasta,
    "spectrum_saved": _saved,
    "unitig_first_wins": lambda s, d: U.first_wins(graph(s, d), K_GRAPH),
    "unitig_classify_reads": _classify,
    "contig_summary": _summary,
    "ngx": _ngx,
    "vector_stats": _vector,
    "argsort": _argsort,
    "jaccard_bits": _bits,
    "set_similarity": _sets,
    "sketch_similarity": _sketches,
    "shared_kmers": _pairs(J.shared_count),
    "shared_kmers_distinct": _pairs(J.shared_distinct),
    "shared_kmer_runs": _runs,
    "tandem_repeat": _tandem,
    "same_sequence": _same,
    "semi_global_align": _align,
}

_PAIRS = f"WITH {READS}, {ITEMS}, {windows(K)}, {windows(K, 'items', 'item_id', 'ki')}, h AS (SELECT DISTINCT read_id, w FROM km), hit AS (SELECT read_id, item_id, pos, ki.w AS w FROM ki JOIN h USING (w))"

ORACLES: dict[str, str] = {
    "kmer_spectrum": on_spectrum("SELECT * FROM sp WHERE cnt > 1"),
    "kmer_count": on_spectrum("SELECT * FROM sp"),
    "kmer_count_long": on_spectrum("SELECT * FROM sp", 31),
    "kmer_positions": f"""WITH {ITEMS}, {windows(16, 'items', 'item_id')}, b AS (SELECT item_id, pos, w, {rc('w')} AS r, max(pos) OVER (PARTITION BY item_id) AS last FROM km)
      SELECT item_id, '+' AS strand, pos::INT AS pos, list_reduce(list_transform(string_split(translate(w, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, x: a * 4 + x) AS code FROM b
      UNION ALL SELECT item_id, '-', (last - pos)::INT, list_reduce(list_transform(string_split(translate(r, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, x: a * 4 + x) FROM b""",
    "seeds_center": f"WITH {READS} SELECT substr(seq, length(seq) // 2 - {K // 2} + 1, {K}) AS kmer, count(*) AS cnt FROM reads WHERE length(seq) >= {K} GROUP BY 1",
    "seeds_half": f"WITH {READS} SELECT substr(seq, length(seq) // 2 + 1, {K}) AS kmer, count(*) AS cnt FROM reads WHERE length(seq) >= {K} AND length(seq) // 2 <= length(seq) - {K} GROUP BY 1",
    "dna_scalars": f"""WITH {READS} SELECT read_id, {rc('seq')} AS revcomp, length(seq)::INT AS n_bases, ((length(seq) + 3) // 4)::INT AS n_bytes, substr(seq, 4, 7) AS sub,
      nullif(substr(seq, 3, 1), '') AS third, substr(seq, 2) AS popped, seq || 'G' AS appended, 'T' || seq AS prepended, lower(seq) AS lower,
      left(seq, 1) || 'T' || substr(seq, 3) AS replaced, CASE WHEN seq <> '' THEN translate(left(seq, 1), 'ACGT', 'TGCA') END AS first_complement FROM reads""",
    "dna_flags": f"""WITH {READS}, {windows(8)} SELECT DISTINCT w AS kmer, w = {rc('w')} AS palindrome, left(w, 3) = {rc('right(w, 3)')} AS hairpin,
      w = repeat(left(w, 1), 8) AS simple, least(w, {rc('w')}) AS canon FROM km""",
    "dna_codes": f"""WITH {READS}, {windows(9)}, d AS (SELECT DISTINCT w, {rc('w')} AS r FROM km)
      SELECT w AS kmer, list_reduce(list_transform(string_split(translate(w, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, x: a * 4 + x) AS code, w AS back,
      list_reduce(list_transform(string_split(translate(r, 'ACGT', '0123'), ''), lambda x: x::BIGINT), lambda a, x: a * 4 + x) AS rc_code FROM d""",
    "dna_neighbours": f"""WITH {READS}, {windows(7)}, d AS (SELECT DISTINCT least(w, {rc('w')}) AS w FROM km)
      SELECT w AS kmer, 'A' || left(w, 6) || ',C' || left(w, 6) || ',G' || left(w, 6) || ',T' || left(w, 6) AS before,
      right(w, 6) || 'A,' || right(w, 6) || 'T,' || right(w, 6) || 'G,' || right(w, 6) || 'C' AS after FROM d""",
    "spectrum_solid": on_spectrum("SELECT * FROM sp WHERE cnt BETWEEN 3 AND 50"),
    "spectrum_metadata": on_spectrum("SELECT count(*) AS n_distinct, sum(cnt)::BIGINT AS n_total, max(cnt) AS max_cnt FROM sp"),
    "spectrum_histogram": on_spectrum("SELECT cnt, count(*) AS n_kmers FROM sp GROUP BY cnt"),
    "spectrum_moments": on_spectrum("SELECT count(*) AS f0, sum(cnt)::BIGINT AS f1_total, count(*) FILTER (cnt = 1) AS f1, count(*) FILTER (cnt = 2) AS f2, count(*) FILTER (cnt = 3) AS f3 FROM sp"),
    "spectrum_scan": on_spectrum("SELECT * FROM sp WHERE kmer >= 'G' ORDER BY kmer"),
    "spectrum_merge": on_halves("SELECT kmer, sum(cnt)::BIGINT AS cnt FROM (FROM a UNION ALL FROM b) GROUP BY kmer"),
    "spectrum_intersect": on_halves("SELECT * FROM a WHERE kmer IN (SELECT kmer FROM b)"),
    "spectrum_intersect_min": on_halves("SELECT kmer, least(a.cnt, b.cnt) AS cnt FROM a JOIN b USING (kmer)"),
    "spectrum_inner_product": on_halves("SELECT coalesce(sum(a.cnt * b.cnt), 0)::BIGINT AS dot FROM a JOIN b USING (kmer)"),
    "spectrum_magnitude": on_spectrum("SELECT floor(sqrt(sum(cnt * cnt)))::BIGINT AS magnitude FROM sp"),
    "spectrum_cosine": on_halves("SELECT round((SELECT sum(a.cnt * b.cnt) FROM a JOIN b USING (kmer)) / sqrt((SELECT sum(cnt * cnt) FROM a)::DOUBLE * (SELECT sum(cnt * cnt) FROM b)::DOUBLE), 6) AS cosine"),
    "spectrum_lookup": on_halves("SELECT b.kmer, coalesce(a.cnt, 0) AS cnt FROM b LEFT JOIN a USING (kmer)"),
    "spectrum_remove": on_halves("SELECT kmer, a.cnt - coalesce(b.cnt, 0) AS cnt FROM a LEFT JOIN b USING (kmer) WHERE a.cnt > coalesce(b.cnt, 0)"),
    "spectrum_delete": on_halves("SELECT * FROM a WHERE kmer NOT IN (SELECT kmer FROM b)"),
    "spectrum_replace": on_halves("SELECT * FROM b UNION ALL SELECT * FROM a WHERE kmer NOT IN (SELECT kmer FROM b)"),
    "planner_recipe": on_spectrum(f"SELECT count(*) - count(*) FILTER (cnt <= 2) AS n_true, round(1 - pow((sum(cnt) - count(*) FILTER (cnt = 1) - 2 * count(*) FILTER (cnt = 2)) / sum(cnt), 1 / {K}.0), 6) AS error FROM sp"),
    "planner_error_profile": """WITH k AS (SELECT unnest([11, 21, 31]) AS k), s AS (SELECT k, unnest(range(0, 101 - k)) AS i FROM k)
      SELECT k::INT AS k, round(sum(p), 6) AS windows FROM (SELECT k, i, product(1 - (0.01::DOUBLE + 0.0002::DOUBLE * j)) AS p FROM (SELECT k, i, unnest(range(i, i + k)) AS j FROM s) GROUP BY k, i) GROUP BY k""",
    "unitigs": UNITIGS + "SELECT unitig_id, seq, len, median_abundance FROM u",
    "unitig_links": UNITIGS + "SELECT src, src_sign, dst, dst_sign, base FROM lk",
    "unitig_totals": UNITIGS + f"SELECT count(*) AS n_unitigs, sum(len)::BIGINT AS total_len, count(*) FILTER (seq = {rc('seq')}) AS n_palindromic FROM u",
    "unitig_ends": UNITIGS + "SELECT end_kmer, unitig_id, sign FROM ends",
    "unitig_fasta": UNITIGS + f"SELECT unitig_id, len::BIGINT AS len, (median_abundance::BIGINT * (len - {K_GRAPH - 1}))::BIGINT AS kmers, median_abundance::BIGINT AS median, seq FROM u",
    "unitig_text": UNITIGS + f""", t AS (SELECT src, string_agg('L:' || CASE src_sign WHEN 1 THEN '+' ELSE '-' END || ':' || dst || ':' || CASE dst_sign WHEN 1 THEN '+' ELSE '-' END, ' '
        ORDER BY CASE src_sign WHEN 1 THEN strpos('ACGT', base) ELSE 10 - strpos('ACGT', base) END, src_sign, dst, dst_sign) AS links FROM lk GROUP BY src)
      SELECT unitig_id, '>' || unitig_id || ' LN:i:' || len || ' KC:i:' || median_abundance::BIGINT * (len - {K_GRAPH - 1}) || ' km:f:' || median_abundance || coalesce(' ' || links, '') || chr(10) || seq AS value
      FROM u LEFT JOIN t ON t.src = u.unitig_id""",
    "unitig_end_index": UNITIGS + "SELECT end_kmer, unitig_id, sign FROM ends QUALIFY row_number() OVER (PARTITION BY end_kmer ORDER BY unitig_id) = 1",
    "fastq_reads": f"WITH {READS} SELECT seq, count(*) AS n FROM reads GROUP BY seq",
    "fasta_records": f"WITH {READS} SELECT read_id || ' doc' AS header, seq FROM reads",
    "spectrum_saved": on_spectrum("SELECT * FROM sp"),
    "unitig_first_wins": UNITIGS + f"SELECT unitig_id, seq, len, median_abundance FROM u QUALIFY row_number() OVER (PARTITION BY left(seq, {K_GRAPH}) ORDER BY unitig_id) = 1",
    "unitig_classify_reads": UNITIGS + f""", c AS (SELECT (left(seq, {K_GRAPH}) IN (SELECT end_kmer FROM ends))::INT + ({rc(f'right(seq, {K_GRAPH})')} IN (SELECT end_kmer FROM ends))::INT AS n FROM reads WHERE length(seq) >= {K_GRAPH})
      SELECT CASE n WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'none' END AS known_ends, count(*) AS n FROM c GROUP BY 1""",
    "contig_summary": """WITH l AS (SELECT length(text) AS len FROM documents), c AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto, sum(len) OVER () AS total FROM l)
      SELECT count(*) AS n_contigs, max(total)::BIGINT AS total, min(len) AS shortest, max(len) AS longest, coalesce(max(len) FILTER (upto >= total // 2), 0) AS n50, coalesce(max(len) FILTER (upto >= 500000), 0) AS ng50 FROM c""",
    "ngx": "SELECT max(len) FILTER (upto >= 1500000) AS ngx FROM (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto FROM (SELECT length(text) AS len FROM documents))",
    "vector_stats": """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_q, round(var_pop(l_quantity) * count(*), 2) AS sq_dev_q, round(median(l_quantity), 6) AS median_q,
      round(corr(l_quantity, l_extendedprice), 6) AS pearson_qp, round(sum(l_quantity * l_linenumber), 2) AS dot_qn FROM lineitem GROUP BY 1""",
    "argsort": "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank FROM customer",
    "jaccard_bits": "SELECT o_orderkey, round(bit_count((o_orderkey + 1) & (o_custkey + 1)) / bit_count((o_orderkey + 1) | (o_custkey + 1)), 6) AS jaccard FROM orders",
    "set_similarity": f"""WITH {ITEMS}, {windows(4, 'items', 'item_id')}, s AS (SELECT item_id, list(DISTINCT w) AS x FROM km GROUP BY 1)
      SELECT a.item_id, len(list_intersect(a.x, b.x)) AS shared, round(len(list_intersect(a.x, b.x)) / len(list_distinct(a.x || b.x)), 6) AS jaccard, round(len(list_intersect(a.x, b.x)) / least(len(a.x), len(b.x)), 6) AS overlap
      FROM s a JOIN s b ON a.item_id = b.item_id + 1""",
    "sketch_similarity": f"""WITH {ITEMS}, {windows(8, 'items', 'item_id')}, s AS (SELECT item_id, list_sort(list(DISTINCT w))[1:16] AS x FROM km GROUP BY 1)
      SELECT a.item_id, round(len(list_intersect(list_intersect(list_sort(list_distinct(a.x || b.x))[1:16], a.x), b.x)) / len(list_sort(list_distinct(a.x || b.x))[1:16]), 6) AS jaccard FROM s a JOIN s b ON a.item_id = b.item_id + 1""",
    "shared_kmers": _PAIRS + " SELECT read_id, item_id, count(*) AS n_shared FROM hit GROUP BY ALL",
    "shared_kmers_distinct": _PAIRS + " SELECT read_id, item_id, count(DISTINCT w) AS n_shared FROM hit GROUP BY ALL",
    "shared_kmer_runs": _PAIRS + """, g AS (SELECT read_id, item_id, pos - row_number() OVER (PARTITION BY read_id, item_id ORDER BY pos) AS g FROM hit),
      r AS (SELECT read_id, item_id, count(*) AS run FROM g GROUP BY read_id, item_id, g HAVING count(*) >= 5), n AS (SELECT item_id, count(*) AS n FROM ki GROUP BY 1)
      SELECT read_id, item_id, sum(run)::BIGINT AS n_in_runs, round(sqrt(sum(run * run) / (max(n) * max(n))), 6) AS ratio FROM r JOIN n USING (item_id) GROUP BY ALL""",
    "tandem_repeat": f"""WITH {READS}, {windows(4)}, b AS (SELECT read_id, w FROM km UNION ALL SELECT read_id, {rc('w')} FROM km), c AS (SELECT read_id, w, count(*) AS n FROM b GROUP BY ALL),
      t AS (SELECT read_id, coalesce(sum(n) FILTER (n >= 10), 0) >= 100 AS is_tandem FROM c GROUP BY 1) SELECT reads.read_id, coalesce(is_tandem, false) AS is_tandem FROM reads LEFT JOIN t USING (read_id)""",
    "same_sequence": f"""WITH {READS}, c AS (SELECT read_id, least(seq, {rc('seq')}) AS c FROM reads WHERE seq <> '')
      SELECT read_id, min(read_id) OVER (PARTITION BY c) AS first FROM c QUALIFY count(*) OVER (PARTITION BY c) > 1""",
    "kmer_fingerprints": f"WITH {READS}, {windows(K)} SELECT ({signed_sql(f'least({hash_sql("w", K)}, {hash_sql("w", K, True)}) % {1 << HB}')}) AS key, count(*) AS cnt FROM km GROUP BY 1",
    "hash_kmers": f"""WITH {READS}, {windows(K)}, h AS (SELECT w AS kmer, {hash_sql('w', K)} AS f, {hash_sql('w', K, True)} AS r FROM (SELECT DISTINCT w FROM km))
      SELECT kmer, {signed_sql('f')} AS forward, {signed_sql('r')} AS reverse, {signed_sql('least(f, r)')} AS canonical, {murmur_sql('kmer', K)}::BIGINT AS murmur,
        {signed_sql(seeded_sql('f', K, 7))} AS seeded_forward, {signed_sql(seeded_sql('least(f, r)', K, 7))} AS seeded FROM h""",
    "hash_multi": f"""WITH n AS (SELECT DISTINCT substr(seq, i, {K}) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM (SELECT upper(regexp_replace(lower(text), '[^acgtn]', '', 'g')) AS seq FROM documents))),
      h AS (SELECT kmer, {hash_sql('kmer', K)} AS f, {hash_sql('kmer', K, True)} AS r, contains(kmer, 'N') AS bad FROM n), c AS (SELECT *, least(f, r) AS c FROM h)
      SELECT kmer, {signed_sql('c')} AS h0, {signed_sql(seeded_sql('c', K, 1))} AS h1, {signed_sql(seeded_sql('c', K, 2))} AS h2, NOT bad AS valid,
        CASE WHEN bad THEN {K} - strpos(reverse(kmer), 'N') ELSE 0 END::INT AS loc_n, CASE WHEN bad THEN 0 ELSE {signed_sql('c')} END AS checked FROM c""",
    "kmer_murmurs": f"""WITH {READS}, {windows(K)}, h AS (SELECT read_id, {murmur_sql('w', K)} AS a, {murmur_sql(rc('w'), K)} AS b FROM km)
      SELECT reads.read_id, count(a) * 2 AS n, coalesce(sum(a) + sum(b), 0)::BIGINT AS total, least(min(a), min(b))::BIGINT AS least FROM reads LEFT JOIN h USING (read_id) GROUP BY 1""",
    "denoise_rounds": _denoise_sql(),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
