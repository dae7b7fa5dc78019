"""Which customers are active, from overlapping contract records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.dates import is_open_ended, parse_date, whole_days
from retentia.functions.numbers import FALSE_WORDS
from retentia.operators.groups import next_value
from retentia.schemas import CONTRACT_FIELDS

DEFAULT_CUTOFF = date(2022, 1, 1)


def explode_contracts(customers: DataFrame, column: str = "contracts_info") -> DataFrame:
    """One row per element of the contract JSON; missing fields are null."""
    parsed = F.from_json(F.col(column), f"array<{CONTRACT_FIELDS}>")
    return (
        customers.where(F.col(column).isNotNull())
        .select("ccod", F.explode(parsed).alias("c"))
        .select("ccod", "c.*")
    )


def valid_keys(rows: DataFrame, exclusions: tuple[str, ...] = (), key: str = "ccod") -> DataFrame:
    """Rows whose key is present, not empty and not a known test code."""
    kept = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return kept.where(~F.col(key).isin(*exclusions)) if exclusions else kept


def next_contract_start(contracts: DataFrame) -> DataFrame:
    """Start of the customer's following contract on the same target."""
    return next_value(contracts, ["ccod", "target"], "start_at", "contract_no", "next_start_at")


def _day(day: date) -> Column:
    return F.lit(day).cast("timestamp")


def resolve_contracts(
    contracts: DataFrame,
    as_of: date,
    cutoff: date = DEFAULT_CUTOFF,
    exclusions: tuple[str, ...] = (),
) -> DataFrame:
    """Final and logical end of every contract, and its days of tenure.

    A missing cancel date is filled from the next contract's start, else the
    own start, when the contract ends at or after ``cutoff``; then from an end
    date before ``as_of``.  The open-ended end date reads as null and sets
    ``open_ended``.
    """
    typed = valid_keys(contracts, exclusions).select(
        "ccod", "contract_no", "target",
        parse_date(F.col("contract_date")).alias("contract_at"),
        parse_date(F.col("start_date")).alias("start_at"),
        parse_date(F.col("end_date")).alias("end_at"),
        parse_date(F.col("cancel_date")).alias("cancel_at"),
        is_open_ended(F.col("end_date")).alias("open_ended"),
        F.upper(F.trim("cancelled")).alias("cancelled"),
        F.col("area"),
    )
    today, end, nothing = _day(as_of), F.col("end_at"), F.lit(None).cast("timestamp")
    filled = F.coalesce(
        F.col("cancel_at"),
        F.when(end >= _day(cutoff), F.coalesce(F.col("next_start_at"), F.col("start_at"))).otherwise(nothing),
    )
    return (
        next_contract_start(typed)
        .withColumn("final_cancel_at", F.coalesce(filled, F.when(end < today, end)))
        .withColumn("logical_end_at", F.coalesce("final_cancel_at", F.when(end > today, today)))
        .withColumn("tenure_days", whole_days(F.col("logical_end_at"), F.col("start_at")))
    )


def active_flag(as_of: date, rule: str = "any") -> Column:
    """Whether a resolved contract counts as active.

    ``any`` needs one of: no final cancel date, flag says not cancelled, ends
    in the future or never.  ``all`` needs the three of them.
    """
    never_cancelled = F.col("final_cancel_at").isNull()
    flag = F.coalesce(F.col("cancelled").isin(FALSE_WORDS), F.lit(False))
    future = F.coalesce(F.col("end_at") > _day(as_of), F.lit(False))
    if rule == "any":
        return never_cancelled | flag | future
    if rule == "all":
        return never_cancelled & flag & (future | F.col("open_ended"))
    raise ValueError(f"rule must be 'any' or 'all', not {rule!r}")


def customer_activity(resolved: DataFrame, as_of: date, rule: str = "any") -> DataFrame:
    """Any active contract, distinct targets and contract count per customer."""
    per_target = (
        resolved.withColumn("_active", active_flag(as_of, rule))
        .groupBy("ccod", "target")
        .agg(F.bool_or("_active").alias("_active"), F.count("contract_no").alias("_contracts"))
    )
    # Counting per target first leaves one small row per target to regroup,
    # and makes the distinct count a plain one.
    return per_target.groupBy("ccod").agg(
        F.bool_or("_active").alias("has_active_contract"),
        F.count("target").alias("unique_targets"),
        F.sum("_contracts").alias("total_contracts"),
    )


def customers_with_status(customers: DataFrame, activity: DataFrame) -> DataFrame:
    """Status on every customer; those without contracts are not active.

    ``total_contracts`` stays null for them.
    """
    return (
        customers.join(activity, "ccod", "left")
        .withColumn("has_active_contract", F.coalesce("has_active_contract", F.lit(False)))
        .withColumn("unique_targets", F.coalesce("unique_targets", F.lit(0)))
        .withColumn("status", F.col("has_active_contract").cast("int"))
    )


def target_summary(resolved: DataFrame) -> DataFrame:
    """Contracts of a customer on one target, and whether all are cancelled."""
    per_number = (
        resolved.where(F.col("target").isNotNull())
        .groupBy("ccod", "target", "contract_no")
        .agg(
            F.count("contract_no").alias("n"),
            F.min("start_at").alias("first_start_at"),
            F.max("end_at").alias("last_end_at"),
            F.count("final_cancel_at").alias("cancels"),
            F.min("final_cancel_at").alias("first_cancel_at"),
            F.max("final_cancel_at").alias("last_cancel_at"),
            F.max("logical_end_at").alias("last_logical_end_at"),
            F.min("logical_end_at").alias("first_logical_end_at"),
            F.sum("tenure_days").alias("tenure_days"),
        )
    )
    summary = per_number.groupBy("ccod", "target").agg(
        F.sum("n").alias("contract_count"),
        F.count("contract_no").alias("distinct_contracts"),
        F.min("first_start_at").alias("first_start_at"),
        F.max("last_end_at").alias("last_end_at"),
        F.sum("cancels").alias("cancel_count"),
        F.min("first_cancel_at").alias("first_cancel_at"),
        F.max("last_cancel_at").alias("last_cancel_at"),
        F.max("last_logical_end_at").alias("last_logical_end_at"),
        F.min("first_logical_end_at").alias("first_logical_end_at"),
        F.coalesce(F.sum("tenure_days"), F.lit(0)).alias("tenure_days"),
    )
    return summary.withColumn(
        "fully_cancelled", F.when(F.col("contract_count") > F.col("cancel_count"), 0).otherwise(1)
    )


def status_by_target(summary: DataFrame) -> DataFrame:
    """Strict variant: active while one target is not fully cancelled."""
    return (
        summary.groupBy("ccod")
        .agg(F.count("target").alias("targets"), F.sum("fully_cancelled").alias("cancelled_targets"))
        .withColumn("status", F.when(F.col("targets") > F.col("cancelled_targets"), 1).otherwise(0))
    )
