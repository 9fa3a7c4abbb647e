"""The streamed count after a restart."""

import pytest

from helixion.operators import kmers as G
from helixion.streaming.denoise import Denoiser, run_stream

READS = "read_id long, seq string"


def to_kmers(df):
    return G.canonical_kmers(df, 5)


def counts(df):
    return {r.kmer: r.cnt for r in df.collect()}


def test_restart_goes_on_and_counts_once(spark, tmp_path):
    src, state, mark = f"file://{tmp_path}/in", f"file://{tmp_path}/state", f"file://{tmp_path}/mark"
    stream = lambda: spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(src)
    first = spark.createDataFrame([(1, "ACGTACGTAC")], READS)
    first.coalesce(1).write.parquet(src)
    run_stream(Denoiser(spark, state, 10**9, 0), stream(), to_kmers, mark)
    first.coalesce(1).write.mode("append").parquet(src)
    again = Denoiser(spark, state, 10**9, 0)
    got = counts(run_stream(again, stream(), to_kmers, mark))
    assert sum(got.values()) == 12 and again.total == 12 and again.batch == 1
    # The same without new input, and without the stream's own memory of what it gave: nothing is counted twice.
    assert counts(run_stream(Denoiser(spark, state, 10**9, 0), stream(), to_kmers, mark)) == got
    d = Denoiser(spark, state, 10**9, 0)
    d.resume()
    d.add(to_kmers(first), 1)
    assert counts(d.state()) == got


def test_kill_between_merge_and_commit(spark, tmp_path, monkeypatch):
    state = f"file://{tmp_path}/state"
    batch = spark.createDataFrame([(1, "ACGTACGTAC")], READS)
    d = Denoiser(spark, state, 1, 1)
    d.add(to_kmers(batch), 0)
    rounds, want = d.rounds, counts(d.state())

    def killed(self):
        raise RuntimeError("killed")

    e = Denoiser(spark, state, 1, 1)
    e.resume()
    assert (e.rounds, e.batch) == (rounds, 0) and rounds == 0
    monkeypatch.setattr(Denoiser, "_commit", killed)
    with pytest.raises(RuntimeError):
        e.add(to_kmers(batch), 1)
    monkeypatch.undo()
    f = Denoiser(spark, state, 1, 1)
    f.resume()
    assert counts(f.state()) == want and f.batch == 0
    f.add(to_kmers(batch), 1)
    once = counts(to_kmers(batch).groupBy("kmer").count().withColumnRenamed("count", "cnt"))
    assert counts(f.state()) == {k: want.get(k, 0) + n for k, n in once.items()}
