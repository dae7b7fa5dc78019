"""Session construction, run-time settings and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# SQL settings every operator relies on. All are run-time settings, so they
# also apply to a session somebody else built.
RUNTIME_CONF = {
    # KST is always converted explicitly, so the session itself stays in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Group statistics are joined back to rows on the group key.  A key that
    # holds a large share of the rows is split by the skew-join rule, also
    # where the split costs one more exchange of already reduced rows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # No sort where the small side of each shuffle partition fits in a map.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Only the month partitions that a job wrote are replaced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Expression call sites cost a round trip per column of a wide table.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    # Keyed state of streams lives on disk, and a batch touches its own keys only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A pandas batch stays small even when rows carry vectors or long texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


# Stored input per shuffle partition.  Columns are pruned and packed, so what is
# shuffled of it is a fraction; small partitions are merged at run time.
INPUT_PER_PARTITION = 1 << 30


def build(app: str = "retentia", master: str | None = None, cores: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    if master and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        )
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Lets a pandas batch end at this size, however long its texts are; a worker holds it several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Lets shuffles start with enough partitions for what is stored below ``folder``.

    Adaptive execution merges partitions but doesn't add any.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, math.ceil(stored / INPUT_PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="retentia-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder the cluster names.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes an intermediate result to the scratch folder and reads it back.

    For results that several later passes read: they start from files that
    outlive any executor, instead of repeating the work or holding a cache.
    ``by``, the last column, gives each of its few values a folder, so a pass
    over one of them reads no other.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, name)
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
