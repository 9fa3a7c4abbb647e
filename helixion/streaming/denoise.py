"""Counting with noise removal in rounds, over batches or a stream.

State is a spectrum table. Each batch is counted and merged into it; while
rounds are left and the state has as many distinct keys as the trigger, keys
seen once are dropped. At the end of input at most one more removal runs. The
result depends on the order of batches once a round runs, so batches are a
function of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixion.operators import spectrum as S
from helixion.plans.lineage import delete, hadoop


@dataclass
class Denoiser:
    """The state table's versions live under ``path``, in a store that all executors share."""

    spark: SparkSession
    path: str
    trigger: int
    rounds: int
    end_denoise: bool = False
    key: str = "kmer"
    version: int = -1
    distinct: int = 0
    total: int = 0
    since_round: list[int] = field(default_factory=lambda: [0])
    batch: int = -1
    """The last micro-batch merged."""
    committed: int = -1
    """The version that a restart begins from."""

    def state(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        old, self.version = self.version, self.version + 1
        n = self.state().agg(F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0))).first()
        self.distinct, self.total = n[0], n[1]
        if old >= 0 and old != self.committed:
            delete(self.spark, f"{self.path}/v{old}")

    def _commit(self) -> None:
        """Writes beside the state what a restart needs; only then the version before goes."""
        row = [(self.batch, self.rounds, self.distinct, self.total, self.since_round)]
        about = self.spark.createDataFrame(row, "batch long, rounds int, distinct long, total long, since_round array<bigint>")
        about.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about/v{self.version}")
        old, self.committed = self.committed, self.version
        if old >= 0 and old != self.version:
            delete(self.spark, f"{self.path}/about/v{old}")
            delete(self.spark, f"{self.path}/v{old}")

    def resume(self) -> None:
        """Goes on from the newest version whose facts were written in full, if there is one."""
        fs, root = hadoop(self.spark, f"{self.path}/about")
        if not fs.exists(root):
            return
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        done = [int(n[1:]) for n in names if fs.exists(hadoop(self.spark, f"{self.path}/about/{n}/_SUCCESS")[1])]
        if done:
            self.version = self.committed = max(done)
            r = self.spark.read.parquet(f"{self.path}/about/v{self.version}").first()
            self.batch, self.rounds, self.distinct, self.total, self.since_round = r["batch"], r["rounds"], r["distinct"], r["total"], list(r["since_round"])

    def add(self, kmers: DataFrame, batch: int | None = None) -> None:
        """Merges one batch of k-mers, then removes singletons if due. A numbered batch that was merged already is skipped."""
        if batch is not None and batch <= self.batch:
            return
        counted = S.count(kmers, self.key)
        before = self.total
        self._write(counted if self.version < 0 else S.merge(self.state(), counted, key=self.key))
        self.since_round[-1] += self.total - before
        if self.rounds > 0 and self.distinct >= self.trigger:
            self._remove()
        if batch is not None:
            self.batch = batch
            self._commit()

    def _remove(self) -> None:
        self._write(S.denoise(self.state()))
        self.rounds -= 1
        self.since_round.append(0)

    def finish(self) -> DataFrame:
        if self.end_denoise and self.version >= 0:
            self._write(S.denoise(self.state()))
        return self.state()


def run_batches(denoiser: Denoiser, batches: Iterable[DataFrame]) -> DataFrame:
    for b in batches:
        denoiser.add(b)
    return denoiser.finish()


def batches_by_id(reads: DataFrame, n: int, key: str = "read_id") -> list[DataFrame]:
    """n batches of reads, by a hash of their id."""
    b = F.pmod(F.xxhash64(key), F.lit(n))
    return [reads.filter(b == i) for i in range(n)]


def run_stream(denoiser: Denoiser, reads: DataFrame, to_kmers: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """The same over a streaming DataFrame of reads, a micro-batch a step, until what is available is used up.

    Started again with the same state path and checkpoint, it goes on from the
    last micro-batch merged; one that is given again counts once.
    """
    denoiser.resume()

    def step(batch: DataFrame, number: int) -> None:
        denoiser.add(to_kmers(batch), number)

    q = reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return denoiser.finish()


def stream_counts(kmers: DataFrame) -> DataFrame:
    """Running counts of a streaming DataFrame of k-mers, without removal: one stateful aggregation."""
    return kmers.groupBy("kmer").agg(F.count("*").alias("cnt"))
