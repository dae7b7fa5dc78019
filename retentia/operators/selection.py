"""Many fits over one table as concurrent Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
# Fits that run at the same time.  Each is a chain of short jobs that leave most of the cluster idle.
PARALLEL = 8


def concurrently(spark: SparkSession, tasks: list[Callable[[], T]], parallel: int = PARALLEL) -> list[T]:
    """Results in the order of the tasks; the first that fails is raised."""
    with ThreadPoolExecutor(max(1, min(parallel, len(tasks)))) as pool:
        # A thread passes on job groups, pools and other local settings of the caller.
        futures = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [f.result() for f in futures]


class kept:
    """A table that many passes read, kept on the executors while the block lasts.

    It is a written table, so a lost executor costs reading its part again.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def __enter__(self) -> DataFrame:
        return self.rows.persist(StorageLevel.MEMORY_AND_DISK)

    def __exit__(self, *failure) -> None:
        self.rows.unpersist()
