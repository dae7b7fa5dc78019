"""Writing tables: append, reload, month partitions and keyed merge.

Every write is one distributed job and raises when it fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "snapshot_month"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def reload(rows: DataFrame, path: str) -> None:
    """Replaces the whole table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_months(rows: DataFrame, path: str, column: str = MONTH, mode: str = "append") -> None:
    """Writes into month partitions, creating the ones that are new.

    ``overwrite`` replaces the months present in ``rows`` and leaves the
    others.  A month is written by as many tasks as its size asks for, also when
    all rows share one month.
    """
    rows.hint("rebalance", F.col(column)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").csv(path, header=True, emptyValue="", nullValue="")


def export_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").json(path, ignoreNullFields=False)


def empty_to_null(rows: DataFrame) -> DataFrame:
    """Empty text means null in the stored tables."""
    texts = [f for f, t in rows.dtypes if t == "string"]
    return rows.withColumns({c: F.nullif(c, F.lit("")) for c in texts})


def merged(current: DataFrame, updates: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Table after an upsert: new measures and ``updated_at``, old ``created_at``.

    ``updates`` has one row per key and no timestamps.  Rows only in the table
    stay as they are.
    """
    measures = [c for c in updates.columns if c not in keys]
    old = current.select(
        *keys, *[F.col(c).alias(f"_old_{c}") for c in [*measures, "created_at", "updated_at"]], F.lit(True).alias("_known")
    )
    both = updates.withColumn("_new", F.lit(True)).join(old, keys, "full")
    is_new = F.col("_new").isNotNull()
    return both.select(
        *keys,
        *[F.when(is_new, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in measures],
        F.coalesce("_old_created_at", now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("_old_updated_at")).alias("updated_at"),
    )


def exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.globStatus(path))


def upsert(
    updates: DataFrame, path: str, staging: str, keys: list[str], partition: str, now: Column
) -> None:
    """Keyed merge into a table partitioned by a key column.

    Only the partitions present in ``updates`` are read and replaced.  The
    updates are evaluated once, into ``staging``, a folder of this batch alone,
    and so are the merged partitions; the table is then overwritten from there,
    so a lost executor or a repeated batch cannot leave a half-merged partition
    behind: a second run finds the staged result and only repeats the last step.
    """
    spark, merging = updates.sparkSession, f"{staging}/merged"
    if not exists(spark, f"{merging}/_SUCCESS"):
        reload(updates, f"{staging}/updates")
        updates = spark.read.schema(updates.schema).parquet(f"{staging}/updates")
        if exists(spark, f"{path}/{partition}=*"):
            # One value per touched partition, so the others are not even listed.
            touched = [r[0] for r in updates.select(partition).distinct().collect()]
            current = spark.read.parquet(path).where(F.col(partition).isin(touched))
            rows = merged(current, updates, keys, now)
        else:
            rows = updates.withColumn("created_at", now).withColumn("updated_at", now)
        # As many files per partition as its size asks for, also when all rows share one.
        reload(rows.hint("rebalance", F.col(partition)), merging)
    staged = spark.read.parquet(merging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
