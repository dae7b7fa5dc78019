"""Run counters that take the place of log output."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.numbers import FALSE_WORDS


def contract_counters(resolved: DataFrame, as_of: date) -> DataFrame:
    """Null counts and overlaps of the three activity conditions, in one pass."""
    no_cancel = F.col("final_cancel_at").isNull()
    flag = F.coalesce(F.col("cancelled").isin(FALSE_WORDS), F.lit(False))
    future = F.coalesce(F.col("end_at") > F.lit(as_of).cast("timestamp"), F.lit(False))
    return resolved.agg(
        F.count(F.lit(1)).alias("contracts"),
        F.count_if(F.col("cancel_at").isNull()).alias("no_cancel_date"),
        F.count_if(no_cancel).alias("no_final_cancel"),
        F.count_if(flag).alias("flag_false"),
        F.count_if(future).alias("ends_later"),
        F.count_if(no_cancel & flag).alias("no_final_and_flag"),
        F.count_if(no_cancel & future).alias("no_final_and_later"),
        F.count_if(flag & future).alias("flag_and_later"),
    )


def value_distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def activity_counters(activity: DataFrame) -> DataFrame:
    """Distinct customers, categories and dates of a re-contact result."""
    return activity.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("ccod").alias("customers"),
        F.countDistinct("category_code").alias("categories"),
        F.countDistinct("aggregate_date").alias("dates"),
    )


def similarity_counters(rows: DataFrame, column: str = "similarity") -> DataFrame:
    return rows.agg(
        F.avg(column).alias("mean"), F.percentile_approx(column, 0.5, 10_000).alias("median"),
        F.min(column).alias("least"), F.max(column).alias("most"),
    )
