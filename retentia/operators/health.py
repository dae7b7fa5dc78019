"""Model health: confidence drift, unknown answers, corrections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.arrays import let
from retentia.functions.numbers import histogram_bin
from retentia.operators.taxonomy import OTHER

BINS = 10
EPSILON = 1e-10


def in_range(column: str, start: datetime, end: datetime, closed: bool = False) -> Column:
    """Half-open by default, so neighbouring periods share no row."""
    upper = F.col(column) <= F.lit(end) if closed else F.col(column) < F.lit(end)
    return (F.col(column) >= F.lit(start)) & upper


def histogram(rows: DataFrame, value: str, period: Column) -> DataFrame:
    """Rows per period and bin; values outside 0..1 are left out."""
    binned = rows.select(period.alias("period"), histogram_bin(F.col(value), BINS).alias("bin"))
    return binned.where("period IS NOT NULL AND bin IS NOT NULL").groupBy("period", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def drift(counts: DataFrame) -> DataFrame:
    """Divergence of the current from the baseline distribution; 0 without data.

    Densities get a small constant, are scaled to sum 1 again and compared as
    sum of p ln(p / q).
    """

    def counted(period: str) -> Column:
        cells = [F.when((F.col("bin") == b) & (F.col("period") == period), F.col("n")) for b in range(BINS)]
        return F.array(*[F.coalesce(F.sum(c), F.lit(0)) for c in cells]).alias(period)

    def total(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)

    def distribution(period: str) -> Column:
        counts_of = F.col(period)
        dense = let(total(counts_of), lambda n: F.transform(counts_of, lambda c: c / n * BINS + EPSILON))
        return let(dense, lambda d: F.transform(d, lambda x: x / total(d)))

    sides = counts.agg(counted("baseline"), counted("current"))
    terms = F.zip_with(distribution("baseline"), distribution("current"), lambda p, q: p * F.ln(p / q))
    filled = (total(F.col("baseline")) > 0) & (total(F.col("current")) > 0)
    return sides.select(F.when(filled, total(terms)).otherwise(0.0).alias("confidence_drift"))


def confidence_drift(
    classified: DataFrame, as_of: datetime, baseline_days: int = 32, current_days: int = 32, closed: bool = False
) -> DataFrame:
    middle = as_of - timedelta(days=current_days)
    start = middle - timedelta(days=baseline_days)
    # An instant in both closed periods counts in both.
    periods = F.filter(
        F.array(
            F.when(in_range("created_at", start, middle, closed), "baseline"),
            F.when(in_range("created_at", middle, as_of, closed), "current"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = classified.where(in_range("created_at", start, as_of, closed)).select(
        "model_confidence", F.explode(periods).alias("period")
    )
    return drift(histogram(rows, "model_confidence", F.col("period")))


def answer_rates(
    classified: DataFrame, as_of: datetime, days: int = 30, other: str = OTHER, closed: bool = False
) -> DataFrame:
    """Share of unknown answers and of corrected rows, in one pass."""
    rows = classified.where(in_range("created_at", as_of - timedelta(days=days), as_of, closed))
    unknown = F.coalesce(F.col("main_category_1_name") == other, F.lit(False))
    corrected = ~F.col("created_at").eqNullSafe(F.col("updated_at"))
    return rows.agg(
        F.coalesce(F.avg(unknown.cast("int")), F.lit(0.0)).alias("unknown_rate"),
        F.coalesce(F.avg(corrected.cast("int")), F.lit(0.0)).alias("correction_rate"),
    )


def model_health(classified: DataFrame, as_of: datetime, name: str, version: str) -> DataFrame:
    """One row for the health table."""
    rates = answer_rates(classified, as_of)
    value = confidence_drift(classified, as_of).scalar()
    return rates.select(
        F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(as_of).alias("checked_at"),
        "unknown_rate", "correction_rate", value.alias("confidence_drift"),
    )


def latest_health(health: DataFrame, n: int = 10) -> DataFrame:
    return health.orderBy(F.desc("checked_at")).limit(n)
