"""Run-scoped storage (A7-A9): lineage cuts, factor and score tables.

Every run writes under ``<spark.checkpoint.dir>/cootensor-runs/<run_id>`` —
a shared folder, never a machine-local one and never a fixed name shared by
runs (D1, D2).  Factors live in one table partitioned by ``iter`` and
``mode`` (``run_id`` is the run folder), so reading one factor prunes to one
partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir


class RunStore:
    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex[:12]
        self.root = run_dir(spark, self.run_id)
        self._cuts: list[str] = []

    # -- lineage cut ----------------------------------------------------
    def cut(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet in the run folder and read it back.

        Unlike ``localCheckpoint`` the copy survives executor loss; unlike a
        fixed name it never overwrites a file a later read still needs.
        """
        path = f"{self.root}/cut/{name or 'df'}-{uuid.uuid4().hex[:8]}"
        df.write.mode("overwrite").parquet(path)
        self._cuts.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self) -> int:
        """How many cuts were made so far."""
        return len(self._cuts)

    def drop_cuts(self, first: int, last: int) -> None:
        """Delete the cuts ``first .. last - 1``: what reads them has been cut or stored itself."""
        for k in range(first, last):
            if self._cuts[k]:
                self._delete(self._cuts[k])
                self._cuts[k] = ""

    # -- factor table ---------------------------------------------------
    def factor_path(self, kind: str = "factors") -> str:
        return f"{self.root}/{kind}"

    def save_factor(self, df: DataFrame, it: int, mode: int, kind: str = "factors") -> DataFrame:
        """Store a factor at ``(iter, mode)`` (A8) and return the stored copy."""
        path = f"{self.factor_path(kind)}/iter={int(it)}/mode={int(mode)}"
        df.write.mode("overwrite").parquet(path)
        self._commit(kind, it, mode)
        return self.load_factor(it, mode, kind)

    def load_factor(self, it: int, mode: int, kind: str = "factors") -> DataFrame:
        t = self.spark.read.option("basePath", self.factor_path(kind)).parquet(
            f"{self.factor_path(kind)}/iter={int(it)}/mode={int(mode)}")
        return t.drop("iter", "mode")

    def factor_table(self, kind: str = "factors") -> DataFrame:
        """The whole factor table with ``iter`` and ``mode`` partition columns."""
        return self.spark.read.parquet(self.factor_path(kind))

    def snapshot(self, factors: list[DataFrame], it: int, kind: str = "saved") -> list[DataFrame]:
        """Copy the live factors to the saved table of this run (A9, fixes D6)."""
        return [self.save_factor(f, it, m, kind) for m, f in enumerate(factors)]

    # -- commit log -------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.delete(p, True))

    def _commit(self, kind: str, it: int, mode: int) -> None:
        """Log that the entry's files are complete: an empty file, created aside and renamed, after all else."""
        jvm = self.spark.sparkContext._jvm
        fs, folder = self._fs(f"{self.root}/commits/{kind}")
        fs.mkdirs(folder)
        name = f"{int(it)}-{int(mode)}"
        aside = jvm.org.apache.hadoop.fs.Path(folder, f".{name}-{uuid.uuid4().hex[:8]}")
        final = jvm.org.apache.hadoop.fs.Path(folder, name)
        if fs.exists(final):
            return
        fs.create(aside, False).close()
        if not fs.rename(aside, final) and not fs.exists(final):
            raise OSError(f"cannot log {kind} {name} in {folder}")

    def committed(self, kind: str = "factors") -> set[tuple[int, int]]:
        """The ``(iter, mode)`` entries whose files are complete; others may be there in part."""
        fs, folder = self._fs(f"{self.root}/commits/{kind}")
        if not fs.exists(folder):
            return set()
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return {tuple(map(int, n.split("-"))) for n in names if not n.startswith(".")}

    # -- scores -----------------------------------------------------------
    def save_score(self, score: DataFrame, it: int) -> None:
        score.write.mode("overwrite").parquet(f"{self.root}/scores/iter={int(it)}")
        self._commit("scores", it, 0)

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/scores")

    # -- cleanup ----------------------------------------------------------
    def drop(self) -> bool:
        """Delete this run's folder (factors, scores, cuts) through the Hadoop
        FileSystem of its path, so it works on HDFS / object stores alike."""
        return self._delete(self.root)
