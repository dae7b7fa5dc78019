"""Incremental reading and the run-to-the-end trigger shared by all streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder, each read exactly once per checkpoint."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(rows: DataFrame, column: str, lateness: str) -> DataFrame:
    """The time column as a timestamp with a lateness bound, beyond which stateful operators drop rows."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def run_available(
    rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> list[dict]:
    """Processes everything there is, batch by batch, and returns the progress of the last batches."""
    running = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    running.awaitTermination()
    return [p for p in running.recentProgress if p["numInputRows"]]


def keep_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Stores each batch in its own folder, so a repeated batch replaces itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")

    return store


def store_first_arrivals(rows: DataFrame, path: str, checkpoint: str, key: str = "rcno") -> list[dict]:
    """Stores the first arrival of every key, however late a repeat comes.

    The keys seen are kept in the state store, which a batch asks for its own
    keys; nothing stored is read again.  Of rows that share a key within a
    batch any one stays.  Null is a key of its own.
    """
    return run_available(rows.dropDuplicates([key]), checkpoint, keep_batch(path))
