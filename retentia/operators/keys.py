"""Which keys to process, and whether two outputs cover the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(rows: DataFrame, key: str = "ccod") -> DataFrame:
    return rows.select(key).distinct()


def restrict_to(rows: DataFrame, keys: DataFrame, key: str = "ccod") -> DataFrame:
    """Rows of the given keys only."""
    return rows.join(keys.select(key), key, "left_semi")


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "ccod") -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key), key, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key: str = "ccod") -> DataFrame:
    """Rows and distinct keys of two outputs, and keys only one of them has.

    Each side is reduced to one row per key before they meet.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, key, "full")
    return both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )


def require_same_keys(left: DataFrame, right: DataFrame, key: str = "ccod") -> None:
    """Raises unless both outputs have the same rows per the key set."""
    d = key_difference(left, right, key).first()
    if d["left_rows"] != d["right_rows"] or d["only_left"] or d["only_right"]:
        raise ValueError(f"outputs differ: {d.asDict()}")


def coverage(left: DataFrame, right: DataFrame, key: str = "ccod") -> DataFrame:
    """Joined rows and distinct keys of an inner join, without building it."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    return a.join(b, key).agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("joined_rows"),
        F.count(F.lit(1)).alias("joined_keys"),
    )


def eligible_prospects(
    prospects: DataFrame, customers: DataFrame, required: list[str], since=None, key: str = "bzno"
) -> DataFrame:
    """Recently registered, complete prospects that are not customers yet."""
    recent = prospects if since is None else prospects.where(F.col("registered_at") >= F.lit(since))
    known = customers.select(F.col("biz_no").alias(key)).where(F.col(key).isNotNull())
    return recent.dropna(subset=required).join(known, key, "left_anti")
