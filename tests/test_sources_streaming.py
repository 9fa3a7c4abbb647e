import bz2
import gzip

import pytest

from helixion.operators import kmers as G
from helixion.operators import spectrum as S
from helixion.sources import reads as R
from helixion.sources import spectrum_store
from helixion.streaming.denoise import Denoiser, batches_by_id, run_batches, run_stream


def fastq_text(seqs):
    return "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs))


SEQS = ["ACGTACGT", "GGTTNACC", "TTTTTTTT"]


@pytest.fixture
def files(tmp_path):
    for name, f in (("a.fq", open), ("b.fq.gz", gzip.open), ("c.fq.bz2", bz2.open)):
        with f(tmp_path / name, "wt") as out:
            out.write(fastq_text(SEQS))
    (tmp_path / "list").write_text("a.fq\n\nb.fq.gz\nc.fq.bz2\n")
    return tmp_path


def test_fastq_by_both_readers(spark, files):
    paths = R.read_list(str(files / "list"), relative=True)
    for df in (R.fastq(spark, paths), R.fastq_records(spark, paths)):
        rows = sorted((r.path.rsplit("/", 1)[1], r.read_id, r.seq) for r in df.collect())
        assert rows == sorted((n, i, s) for n in ("a.fq", "b.fq.gz", "c.fq.bz2") for i, s in enumerate(SEQS))


def test_missing_files_fail_unless_skipped(spark, files):
    paths = [str(files / "a.fq"), str(files / "none.fq")]
    with pytest.raises(Exception):
        R.fastq(spark, paths).count()
    assert R.fastq(spark, paths, skip_missing=True).count() == 3


def test_wrapped_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one a\nACGT\nGG\n>two\nTT\r\nAA\n")
    assert sorted((r.header, r.seq) for r in R.fasta(spark, [str(tmp_path / "x.fa")]).collect()) == [("one a", "ACGTGG"), ("two", "TTAA")]


def test_spectrum_store(spark, tmp_path):
    sp = S.count(G.canonical_kmers(spark.createDataFrame([(0, "ACGTACGTAA")], "read_id long, seq string"), 5))
    spectrum_store.save(sp, str(tmp_path / "s"), 5)
    assert sorted(spectrum_store.load(spark, str(tmp_path / "s"), 5).collect()) == sorted(sp.collect())
    assert spectrum_store.about(spark, str(tmp_path / "s")).first().k == 5
    with pytest.raises(ValueError):
        spectrum_store.load(spark, str(tmp_path / "s"), 7)


def many(spark):
    seqs = ["ACGGTCATTGCA", "GGTCATTGCACC", "TCATTGCACCGA", "ACGGTCATAGCA", "GATTACAGATTA"]
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")


def as_dict(df):
    return {r.kmer: r.cnt for r in df.collect()}


def test_no_rounds_is_the_exact_multiset(spark, tmp_path):
    d = Denoiser(spark, str(tmp_path), 1, 0)
    got = run_batches(d, [G.canonical_kmers(b, 5) for b in batches_by_id(many(spark), 3)])
    want = as_dict(S.count(G.canonical_kmers(many(spark), 5)))
    assert as_dict(got) == want and (d.distinct, d.total) == (len(want), sum(want.values()))


def test_end_removal_only_drops_singletons(spark, tmp_path):
    d = Denoiser(spark, str(tmp_path), 1, 0, end_denoise=True)
    got = as_dict(run_batches(d, [G.canonical_kmers(b, 5) for b in batches_by_id(many(spark), 2)]))
    assert got == {k: c for k, c in as_dict(S.count(G.canonical_kmers(many(spark), 5))).items() if c > 1}


def test_rounds_run_at_the_trigger(spark, tmp_path):
    parts = [G.canonical_kmers(b, 5) for b in batches_by_id(many(spark), 2)]
    d = Denoiser(spark, str(tmp_path), 1, 1)
    got = as_dict(run_batches(d, parts))
    first = {k: c for k, c in as_dict(S.count(parts[0])).items() if c > 1}
    for k, c in as_dict(S.count(parts[1])).items():
        first[k] = first.get(k, 0) + c
    assert got == first and d.rounds == 0 and len(d.since_round) == 2


def test_stream_equals_batches(spark, tmp_path):
    many(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").parquet(str(tmp_path / "in"))
    d = Denoiser(spark, str(tmp_path / "state"), 1, 0, end_denoise=True)
    got = as_dict(run_stream(d, stream, lambda b: G.canonical_kmers(b, 5), str(tmp_path / "cp")))
    assert got == {k: c for k, c in as_dict(S.count(G.canonical_kmers(many(spark), 5))).items() if c > 1}


def test_command_line_functions(spark, files, tmp_path):
    from helixion import cli

    got, plan = cli.count(spark, cli.CountOptions(k=5, n_true=10, total=40, input=str(files / "list"), output=str(tmp_path / "sp"), alpha=0.01, rounds=0))
    assert plan.rounds == 0 and as_dict(got) == {k: c * 3 for k, c in as_dict(S.count(G.canonical_kmers(spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "read_id long, seq string"), 5))).items()}
    found = cli.build(spark, cli.UnitigOptions(k=5, spectrum=str(tmp_path / "sp"), output=str(tmp_path / "u.fa")))
    assert found.count() > 0
