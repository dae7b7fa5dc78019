"""Which features push a customer's churn score, as importance-weighted z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.numbers import round_even
from retentia.operators.groups import one_row
from retentia.schemas import GRANULAR_FEATURES, MODEL_FEATURES, WINDOWS

TOP = 10
HIGH, MEDIUM = 0.3, 0.2

# Factor on a feature's value before scoring.
BOOSTS = {
    "voc_30d": 2.0,
    "cancelled_30d": 2.5,
    "cancelled_60d": 2.5,
    "cancelled_90d": 2.5,
    "work_types_30d": 1.8,
    "work_types_60d": 1.8,
    "work_types_90d": 1.8,
    "cancellation_rate_30d": 3.0,
    "cancellation_rate_60d": 3.0,
    "cancellation_rate_90d": 3.0,
    "confirmation_rate_30d": 0.3,
    "confirmation_rate_60d": 0.3,
    "confirmation_rate_90d": 0.3,
    "csi_score_30d": 0.5,
}

# Weight of single features in the explanation.
NAMED_WEIGHTS = {
    "confirmed_90d": 0.01, "work_types_30d": 0.2, "work_types_90d": 0.1, "work_types_60d": 2.0,
    "cancelled_30d": 12.0, "cancelled_60d": 12.0, "cancelled_90d": 12.0,
    "cancellation_rate_30d": 15.0, "cancellation_rate_60d": 15.0, "cancellation_rate_90d": 15.0,
    "voc_30d": 7.0, "voc_60d": 7.0, "voc_90d": 7.0,
    "services_30d": 5.0, "services_60d": 5.0, "services_90d": 5.0,
    "work_last_30d": 4.0, "work_last_60d": 4.0,
    "confirmed_30d": 4.0, "confirmed_60d": 4.0,
}
CSI_WEIGHT, RATE_WEIGHT, CHANGE_WEIGHT, OTHER_WEIGHT = 6.0, 5.0, 7.0, 2.0

# Display names of the features.
_WINDOW_NAMES = {
    "work_last": "작업수", "confirmed": "확정수", "cancelled": "취소수", "services": "서비스수",
    "work_types": "작업유형수", "cancellation_rate": "취소비율", "confirmation_rate": "확정비율",
    "interactions": "상호작용수", "voc": "VOC수", "non_voc": "비VOC수", "voc_ratio": "VOC비율",
    "csi_score": "평균CSI점수", "csi_survey_count": "CSI설문수",
}
DISPLAY_NAMES = {f"{stem}_{d}d": f"최근{d}일_{name}" for stem, name in _WINDOW_NAMES.items() for d in WINDOWS} | {
    "cancelled_work": "총_취소작업수",
    "unique_work_types": "작업유형_다양성",
    "avg_services_per_work": "평균_서비스수",
    "cancellation_rate": "전체_취소비율",
    "confirmation_rate": "전체_확정비율",
    "num_interactions": "총_상호작용수",
    "voc_count": "총_VOC수",
    "non_voc_count": "총_비VOC수",
    "voc_ratio": "VOC_비율",
    "recent_90d_activity_ratio": "최근90일_활동비율",
    "recent_30d_activity_ratio": "최근30일_활동비율",
    "activity_density": "활동_밀도",
    "confirmation_rate_change": "확정비율_변화",
    "cancellation_rate_change": "취소비율_변화",
    "voc_to_work_ratio": "VOC_대_작업비율",
    "recent_30d_to_90d_ratio": "최근30일_대_90일_비율",
    "avg_csi_score": "평균_CSI점수",
    "csi_survey_count": "총_CSI설문수",
}


def diversity_weight(feature: str) -> float:
    """Weight of a feature by name; the display names of derived features count too."""
    if feature in NAMED_WEIGHTS:
        return NAMED_WEIGHTS[feature]
    # Derived features are known by their display name where weights are set.
    name = DISPLAY_NAMES[feature] if feature in GRANULAR_FEATURES else feature
    if "csi" in name.lower():
        return CSI_WEIGHT
    if "비율" in name or "rate" in name.lower():
        return RATE_WEIGHT
    if "변화" in name:
        return CHANGE_WEIGHT
    return OTHER_WEIGHT


def scoring_variant(features: DataFrame, variant: str = "diverse") -> DataFrame:
    """Feature values as the model scores them.

    ``diverse`` caps ``confirmed_90d`` at mean + half a deviation, takes a
    tenth of its log1p, and boosts fourteen features.  ``log`` and ``original``
    are the plain alternatives, ``capped`` and ``scaled`` complete the set.
    """
    target = F.col("confirmed_90d")
    if variant == "original":
        return features
    if variant == "log":
        return features.withColumn("confirmed_90d", F.log1p(target))
    if variant == "capped":
        return features.withColumn("confirmed_90d", F.least(target, F.lit(20)))
    if variant == "scaled":
        return features.withColumn("confirmed_90d", target * 0.5)
    if variant != "diverse":
        raise ValueError(f"unknown variant {variant!r}")
    cap = features.agg(F.avg("confirmed_90d") + 0.5 * F.stddev_samp("confirmed_90d")).scalar()
    capped = F.log1p(F.least(target, F.coalesce(cap, target))) * 0.1
    return features.withColumns(
        {"confirmed_90d": capped, **{f: F.col(f) * factor for f, factor in BOOSTS.items()}}
    )


def top_contributions(
    features: DataFrame,
    importance: list[float],
    names: list[str] = MODEL_FEATURES,
    k: int = TOP,
    places: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The k strongest contributions of every customer, strongest first, beside the columns to ``keep``.

    Contribution = importance x z-score x weight; equal strengths keep feature
    order.  Statistics cover the whole scoring set.  Everything happens inside
    the row.  ``places`` rounds contributions before ranking.
    """
    stats = features.agg(
        F.array(*[F.avg(f) for f in names]).alias("mean"), F.array(*[F.stddev_samp(f) for f in names]).alias("dev")
    )
    rows = features.select(
        "ccod", *keep, F.array(*[F.col(f).cast("double") for f in names]).alias("values"), one_row(stats).alias("s")
    )
    factors = F.array(*[F.lit(w * diversity_weight(f)) for f, w in zip(names, importance, strict=True)])
    labels = F.array(*[F.lit(f) for f in names])

    def item(value: Column, i: Column) -> Column:
        mean, dev = F.get(F.col("s")["mean"], i), F.get(F.col("s")["dev"], i)
        z = F.when(dev > 0, (value - mean) / dev).otherwise(0.0)
        contribution = F.get(factors, i) * z
        if places is not None:
            contribution = F.round(contribution, places) + F.lit(0.0)
        return F.struct(
            (-F.abs(contribution)).alias("o"), i.alias("i"), value.alias("value"), contribution.alias("contribution")
        )

    strongest = F.slice(F.sort_array(F.transform("values", item)), 1, k)
    named = F.transform(
        strongest,
        lambda x: F.struct(
            F.get(labels, x["i"]).alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution")
        ),
    )
    return rows.select("ccod", *keep, named.alias("top"))


def class_means(features: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Mean of every feature per class."""
    return features.groupBy(label).agg(*[F.avg(f).alias(f) for f in names])


def mean_maps(means: DataFrame, label: str, names: list[str]) -> dict[int, dict[str, float]]:
    """Class means as dictionaries: two rows."""
    return {r[label]: {f: r[f] for f in names} for r in means.collect()}


def impact_label(contribution: Column) -> Column:
    strength = F.abs(contribution)
    return F.when(strength >= HIGH, "높음").when(strength >= MEDIUM, "보통").otherwise("낮음")


def wide_explanation(
    explained: DataFrame, normal_means: dict[str, float], churn_means: dict[str, float], k: int = TOP
) -> list[Column]:
    """Six columns per explained feature; each table of names or means is one literal, built once."""

    def table(values: dict[str, float | None]) -> Column | None:
        known = [f"'{f}', {float(m)!r}D" for f, m in values.items() if m is not None]
        return F.expr(f"map({', '.join(known)})") if known else None

    def mean_of(means: Column | None, feature: Column) -> Column:
        return F.lit(0.0) if means is None else F.coalesce(F.try_element_at(means, feature), F.lit(0.0))

    names = F.expr("map(" + ", ".join(f"'{f}', '{n}'" for f, n in DISPLAY_NAMES.items()) + ")")
    normal, churned = table(normal_means), table(churn_means)
    columns = []
    for n in range(1, k + 1):
        t = F.get("top", F.lit(n - 1))
        columns += [
            F.coalesce(F.try_element_at(names, t["feature"]), t["feature"]).alias(f"feature_{n}_kor"),
            round_even(t["value"], 4).alias(f"feature_{n}_value"),
            round_even(mean_of(normal, t["feature"]), 4).alias(f"feature_{n}_normal_average"),
            round_even(mean_of(churned, t["feature"]), 4).alias(f"feature_{n}_churn_average"),
            round_even(t["contribution"], 4).alias(f"feature_{n}_contrib"),
            F.when(t["feature"].isNotNull(), impact_label(t["contribution"])).alias(f"feature_{n}_contrib_label"),
        ]
    return columns
