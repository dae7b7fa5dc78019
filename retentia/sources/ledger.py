"""Tables of a run that become visible together, batch by batch.

Each batch writes its rows of every table into a folder of its own; when all are
written, one empty file in ``_committed`` makes the batch count.  Readers see
committed batches only, so a run that dies between two tables shows nothing of
itself, and running it again replaces what it left.  Batches are numbered in the
order in which they are run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retentia.sources import sinks

BATCH = "batch"


class BatchLedger:
    """Batches below one folder, written by one run at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int:
        """Number of the last committed batch, -1 before the first."""
        folder = self._path(f"{self.root}/_committed")
        if not self._files.exists(folder):
            return -1
        return max((int(f.getPath().getName()) for f in self._files.listStatus(folder)), default=-1)

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/{BATCH}={batch}"

    def write(self, table: str, batch: int, rows: DataFrame, counters: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
        """Replaces the batch's rows of a table; returns them as stored, and counters taken while they were written."""
        if batch <= self.last():
            raise ValueError(f"batch {batch} is committed")
        seen = Observation()
        observed = rows.observe(seen, *[c.alias(n) for n, c in counters.items()]) if counters else rows
        folder = self._folder(table, batch)
        sinks.reload(observed, folder)
        return self.spark.read.schema(rows.schema).parquet(folder), seen.get if counters else {}

    def commit(self, batch: int) -> None:
        if not self._files.createNewFile(self._path(f"{self.root}/_committed/{batch:012d}")):
            raise RuntimeError(f"batch {batch} was committed by another run")

    def read(self, table: str) -> DataFrame:
        """All rows of committed batches, with the number of their batch; others aren't even listed as read."""
        return self.spark.read.parquet(f"{self.root}/{table}").where(F.col(BATCH) <= self.last())

    def read_with(self, table: str, batch: int, own: DataFrame) -> DataFrame:
        """Committed rows and those of a batch that isn't committed yet."""
        if self.last() < 0:
            return own
        return self.read(table).drop(BATCH).unionByName(own)

    def latest(self, table: str, keys: list[str]) -> DataFrame:
        """Of rows that several batches have for a key the last one's: the state of a table that batches merge into."""
        rows = self.read(table)
        values = F.struct(*[c for c in rows.columns if c not in keys])
        return rows.groupBy(*keys).agg(F.max_by(values, BATCH).alias("v")).select(*keys, "v.*").drop(BATCH)


def run_batch(ledger: BatchLedger, batch: int, body: Callable[[BatchLedger, int], None]) -> bool:
    """Runs and commits a batch unless it is committed already; says whether it ran."""
    if batch <= ledger.last():
        return False
    body(ledger, batch)
    ledger.commit(batch)
    return True
