"""Repeatable splits that do not depend on how the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hash range cut in the first pass; the second pass ranks one bucket of a class.
BUCKETS = 65_536


def hash_order(key: str, seed: int) -> Column:
    """A 60-bit number from the key and a seed."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stratified_split(
    rows: DataFrame, key: str, label: str, fraction: float, seed: int = 42, into: str = "held_out"
) -> DataFrame:
    """Marks round(n x fraction) rows of every class as held out.

    The rows with the smallest hashes are held out.  Counts per hash bucket
    find the bucket where a class reaches its quota, and ranking that bucket
    finds the last row held out.  The mark itself is a comparison inside each
    row, so no class is ordered or moved as a whole.
    """
    hashed = rows.withColumn("_h", hash_order(key, seed))
    bucket = F.floor(F.col("_h") / F.lit(2**60 // BUCKETS)).cast("int")
    counts = hashed.groupBy(label, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    # At most BUCKETS rows per class are left here.
    upto = Window.partitionBy(label).orderBy("_b")
    quota = counts.withColumn(
        "_quota", F.round(F.sum("_n").over(Window.partitionBy(label)) * fraction)
    ).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    cut = quota.where(
        (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota"))
    ).select(label, "_b", (F.col("_quota") - F.col("_before")).alias("_rest"))
    # One row per class: a broadcast of that size is safe for any class label.
    in_cut = hashed.select(label, key, "_h", bucket.alias("_b")).join(F.broadcast(cut), [label, "_b"])
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    last = (
        in_cut.withColumn("_r", place)
        .where(F.col("_r") == F.col("_rest"))
        .select(label, F.col("_h").alias("_last_h"), F.col(key).alias("_last_key"))
    )
    upto_last = F.struct(F.col("_h"), F.col(key)) <= F.struct(F.col("_last_h"), F.col("_last_key"))
    return (
        hashed.join(F.broadcast(last), label, "left")
        .withColumn(into, F.when(F.col("_last_h").isNotNull() & upto_last, 1).otherwise(0))
        .select(*rows.columns, into)
    )


def first_by_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n distinct rows by key."""
    return rows.distinct().orderBy(key).limit(n)
