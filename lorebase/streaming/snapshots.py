"""Partial aggregates of micro-batches, kept as snapshots behind a batch fence.

Every batch is written under its id, so a batch that runs again replaces itself. Each `every` batches all are merged into a
snapshot that says up to which batch it holds them; what it holds is deleted and not read any more. A batch that
runs again after its snapshot was finished is behind the fence and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """merge: from rows of several batches to one row per key, with the same columns."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to their end."""
        found = self.files.globStatus(self.at(f"{self.path}/{kind}-*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        if batch_id <= max(self._finished("upto"), default=-1):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        self.read().write.mode("overwrite").parquet(f"{self.path}/upto-{upto}")
        for kind in ("upto", "batch"):
            for n in self._finished(kind):
                if n < upto or (kind == "batch" and n <= upto):
                    self.files.delete(self.at(f"{self.path}/{kind}-{n}"), True)

    def read(self) -> DataFrame:
        """All that was written, merged."""
        fence = max(self._finished("upto"), default=-1)
        names = [f"upto-{fence}"] * (fence >= 0) + [f"batch-{n}" for n in self._finished("batch") if n > fence]
        return self.merge(reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}") for n in names]))
