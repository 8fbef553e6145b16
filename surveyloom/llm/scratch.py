"""Shared pieces of the text operators: shipping the package, tables in the shared folder, typed inputs."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.session import scratch_path

PACKAGE = "surveyloom"
BATCH_BYTES = 4 << 20
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless this application already has it.

    Texts go to the workers in Arrow batches of ``BATCH_BYTES``: several copies of a batch exist at once, beside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not any(os.path.basename(f).startswith(PACKAGE) for f in sc._python_includes):
        base = os.path.join(tempfile.mkdtemp(prefix=f"{PACKAGE}-package-"), PACKAGE)
        sc.addPyFile(shutil.make_archive(base, "zip", ROOT, PACKAGE))


class Scratch:
    """Tables of one step in the shared folder. Leaving the block removes them all, also after an error.

    ``keep`` writes a table that outlives the block: the result, which later readers scan. ``free_shuffles``: Spark drops the shuffle
    files of a table as soon as it is written, not only when its plan is garbage; the session's own setting holds again afterwards.
    """

    def __init__(self, spark: SparkSession, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        if self.free_shuffles:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.free_shuffles and before is not None:
                self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, name))
        return self._write(df, self.paths[-1])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, scratch_path(self.spark, name))

    def settle(self, *names: str) -> None:
        """Free disk: remove the tables of these names, and let the driver collect plans, so that Spark drops their shuffle files.

        What was written needs no shuffle any more, but its files stay on the executors until the plan is garbage.
        """
        for path in [p for p in self.paths if any(p.rsplit("/", 1)[-1].startswith(f"{n}-") for n in names)]:
            remove(self.spark, path)
            self.paths.remove(path)
        gc.collect()
        self.spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(df: DataFrame, text: str = "text", key: str = "doc_id", also: Sequence[str] = ()) -> DataFrame:
    """Only the columns an operator works on, so that extra columns, whatever their names, cannot clash with its own."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *also)


def tasks_for(df: DataFrame) -> int:
    """Number of range or hash partitions asked for where the count is part of a call: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
