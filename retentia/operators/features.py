"""57 churn features from work, survey and interaction history.

Windows end at the customer's own latest date.  That date is one aggregate per
customer; the rows get it by a join on the customer key, and every later
grouping starts with that key, so the join's shuffle serves all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.dates import parse_date, whole_days
from retentia.functions.numbers import lenient_double, ratio, smooth_ratio
from retentia.operators import history
from retentia.schemas import (
    COUNT_FEATURES,
    CSI_FEATURES,
    HELPER_FEATURES,
    INTERACTION_FIELDS,
    MODEL_FEATURES,
    VOC_FEATURES,
    WINDOWS,
    WORK_FEATURES,
)
from retentia.session import materialise


def attach_children(works: DataFrame, services: DataFrame, surveys: DataFrame) -> DataFrame:
    """Number of services, and sum and count of readable scores, per work.

    The children are reduced to one row per work before they meet their parent.
    """
    counted = services.groupBy("work_no").agg(F.count(F.lit(1)).alias("n_services"))
    score = lenient_double(F.col("csi_score"))
    scored = surveys.groupBy("work_no").agg(F.sum(score).alias("csi_sum"), F.count(score).alias("csi_count"))
    return (
        works.join(counted, "work_no", "left")
        .join(scored, "work_no", "left")
        .fillna({"n_services": 0, "csi_sum": 0.0, "csi_count": 0})
    )


# What is summed of works and of interactions; scores of a work without a date don't count.
WORK = history.Measures(
    {
        "work": "1", "confirmed": "CAST(confirmed AS INT)", "cancelled": "CAST(cancelled AS INT)",
        "services": "n_services", "csi_sum": "csi_sum", "csi_count": "csi_count",
    },
    dated=("csi_sum", "csi_count"),
)
INTERACTIONS = history.Measures({"interactions": "1"})


def work_moments(works: DataFrame) -> DataFrame:
    """``works``: ccod, work_at, work_type, confirmed, cancelled, n_services, csi_sum, csi_count."""
    return WORK.moments(works, F.col("work_type"), "work_at")


def interaction_moments(interactions: DataFrame) -> DataFrame:
    """``interactions``: ccod, event_type, event_at."""
    return INTERACTIONS.moments(interactions, F.coalesce(F.col("event_type") == "VOC", F.lit(False)), "event_at")


def work_totals(by_kind: DataFrame) -> DataFrame:
    """One row per customer with all window totals, before the rates, from the rows per work type."""
    # One row per type is left, so a distinct count is a count of rows.
    renamed = {"work": "work_count", "confirmed": "confirmed_work", "cancelled": "cancelled_work"}
    renamed |= {f"work_{d}d": f"work_last_{d}d" for d in WINDOWS} | {f"csi_count_{d}d": f"csi_survey_count_{d}d" for d in WINDOWS}
    sums = [c for n in WORK.sums for c in (n, *[f"{n}_{d}d" for d in WINDOWS])]
    named = F.col("kind") != ""
    return by_kind.groupBy("ccod").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(renamed.get(c, c)) for c in sums],
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.count_if(named).alias("unique_work_types"),
        *[F.count_if(named & (F.col(f"work_{d}d") > 0)).alias(f"work_types_{d}d") for d in WINDOWS],
    )


def work_features(works: DataFrame) -> DataFrame:
    """Work and survey features, 37 of them, one row per customer; the works are read once."""
    return work_features_of(history.by_kind(materialise(work_moments(works), "works"), WORK))


def work_features_of(by_kind: DataFrame) -> DataFrame:
    """The work features from totals and windows per customer and work type."""
    t = work_totals(by_kind)
    columns = {
        "work_span_days": F.coalesce(whole_days(F.col("last_at"), F.col("first_at")), F.lit(0)),
        "cancellation_rate": ratio(F.col("cancelled_work"), F.col("work_count")),
        "confirmation_rate": ratio(F.col("confirmed_work"), F.col("work_count")),
        "avg_services_per_work": ratio(F.col("services"), F.col("work_count")),
        "avg_csi_score": ratio(F.col("csi_sum"), F.col("csi_count")),
        "csi_survey_count": F.col("csi_count"),
    }
    for d in WINDOWS:
        work = F.col(f"work_last_{d}d")
        columns |= {
            f"cancellation_rate_{d}d": ratio(F.col(f"cancelled_{d}d"), work),
            f"confirmation_rate_{d}d": ratio(F.col(f"confirmed_{d}d"), work),
            f"csi_score_{d}d": ratio(F.col(f"csi_sum_{d}d"), F.col(f"csi_survey_count_{d}d")),
        }
    return t.withColumns(columns).select("ccod", *WORK_FEATURES, *CSI_FEATURES)


def explode_interactions(customers: DataFrame, column: str = "interaction_history") -> DataFrame:
    """One row per interaction of the JSON text; the first present date counts."""
    parsed = F.from_json(F.col(column), f"array<{INTERACTION_FIELDS}>")
    return (
        customers.select("ccod", F.explode(parsed).alias("i"))
        .select("ccod", "i.*")
        .select("ccod", "event_type", interaction_date("event_date", "date").alias("event_at"))
    )


def interaction_date(*columns: str) -> Column:
    """First non-empty of several date texts."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in columns]
    return parse_date(F.coalesce(*texts))


def voc_features(interactions: DataFrame) -> DataFrame:
    """Interaction features, 16 of them, one row per customer; the interactions are read once."""
    return voc_features_of(history.by_kind(materialise(interaction_moments(interactions), "interactions"), INTERACTIONS))


def voc_features_of(by_kind: DataFrame) -> DataFrame:
    """The interaction features from totals and windows per customer and kind, which is whether it is a claim."""
    def both(name: str, into: str, claims: str) -> list[Column]:
        return [F.sum(name).alias(into), F.coalesce(F.sum(F.when(F.col("kind"), F.col(name))), F.lit(0)).alias(claims)]

    counts = both("interactions", "num_interactions", "voc_count")
    for d in WINDOWS:
        counts += both(f"interactions_{d}d", f"interactions_{d}d", f"voc_{d}d")
    counted = by_kind.groupBy("ccod").agg(*counts)
    columns = {
        "non_voc_count": F.col("num_interactions") - F.col("voc_count"),
        "voc_ratio": ratio(F.col("voc_count"), F.col("num_interactions")),
    }
    for d in WINDOWS:
        columns |= {
            f"non_voc_{d}d": F.col(f"interactions_{d}d") - F.col(f"voc_{d}d"),
            f"voc_ratio_{d}d": ratio(F.col(f"voc_{d}d"), F.col(f"interactions_{d}d")),
        }
    return counted.withColumns(columns).select("ccod", *VOC_FEATURES)


def granular_features(features: DataFrame) -> DataFrame:
    """Seven features derived from the others."""
    c = F.col
    return features.withColumns(
        {
            "recent_90d_activity_ratio": smooth_ratio(c("work_last_90d"), c("work_count")),
            "recent_30d_activity_ratio": smooth_ratio(c("work_last_30d"), c("work_count")),
            "activity_density": c("work_count") / (c("work_span_days") + 1),
            "confirmation_rate_change": c("confirmation_rate_30d") - c("confirmation_rate"),
            "cancellation_rate_change": c("cancellation_rate_30d") - c("cancellation_rate"),
            "voc_to_work_ratio": smooth_ratio(c("voc_count"), c("work_count")),
            "recent_30d_to_90d_ratio": smooth_ratio(c("work_last_30d"), c("work_last_90d")),
        }
    )


def customer_features(customers: DataFrame, work: DataFrame, voc: DataFrame, *, helpers: bool = False) -> DataFrame:
    """All features for every customer; no history means zeros.

    Both feature tables are already partitioned by customer.
    """
    base = (
        customers.select("ccod")
        .join(work, "ccod", "left")
        .join(voc, "ccod", "left")
        .fillna(0, subset=[*WORK_FEATURES, *CSI_FEATURES, *VOC_FEATURES])
    )
    kept = MODEL_FEATURES + (HELPER_FEATURES if helpers else [])
    return granular_features(base).select("ccod", *kept)


def monthly_property(features: DataFrame) -> DataFrame:
    """Feature table as stored: counts are integers, the rest doubles."""
    typed = [f"CAST({f} AS {'INT' if f in COUNT_FEATURES else 'DOUBLE'}) AS {f}" for f in MODEL_FEATURES]
    return features.selectExpr("ccod", *typed)


def churn_label(rule: dict[str, int] | None = None) -> Column:
    """1 when recent activity is at most the given counts in every window."""
    limits = rule or {"work_last_30d": 0, "work_last_60d": 1, "work_last_90d": 2}
    met = reduce(lambda a, b: a & b, [F.col(f) <= n for f, n in limits.items()])
    return F.when(met, 1).otherwise(0)


def training_rows(features: DataFrame, min_work: int = 5, rule: dict[str, int] | None = None) -> DataFrame:
    """Customers with enough history, labelled."""
    return features.where(F.col("work_last_90d") >= min_work).withColumn("churn", churn_label(rule))
