"""Table layouts and the one list of feature names used by every consumer."""

from __future__ import annotations

from pyspark.sql import DataFrame

CONTRACT_FIELDS = (
    "struct<contract_no:string,target:string,contract_date:string,start_date:string,"
    "end_date:string,cancel_date:string,cancelled:string,cancel_no:string,area:double>"
)

INTERACTION_FIELDS = "struct<event_type:string,event_date:string,date:string,content:string>"

PURCHASE_FIELDS = "struct<service_name:string,purchase_date:string,quantity:int>"

CATEGORY_FIELDS = "struct<major:string,mid:string,minor:string,reason:string>"

RESPONSE_FIELDS = (
    "is_claim string, summary string, bug_type string, keywords array<string>, "
    f"categories array<{CATEGORY_FIELDS}>"
)

PROFILE_FIELDS = [
    "ccod", "name", "type_major", "type_mid", "ceo", "zip", "addr1", "addr2", "dept",
    "biz_type", "biz_item", "biz_no", "gender", "nationality", "class_code", "registered",
]

PROSPECT_COLUMNS = [
    "snapshot_month", "kedcd", "bzpl_cd", "bzpl_seq", "bzno", "enp_nm", "sido", "sigungu",
    "lat", "lot", "bzpl_nm", "bf_bzc_cd", "bsze_metr", "lsze_metr", "rdnm_addr",
]

WINDOWS = (30, 60, 90)


def _windowed(*stems: str) -> list[str]:
    return [f"{stem}_{days}d" for days in WINDOWS for stem in stems]


WORK_FEATURES = (
    [
        "work_count", "unique_work_types", "confirmed_work", "cancelled_work", "work_span_days",
        "cancellation_rate", "confirmation_rate", "avg_services_per_work",
    ]
    + _windowed(
        "work_last", "confirmed", "cancelled", "services", "work_types",
        "cancellation_rate", "confirmation_rate",
    )
)

CSI_FEATURES = (
    ["avg_csi_score"] + [f"csi_score_{d}d" for d in WINDOWS]
    + ["csi_survey_count"] + [f"csi_survey_count_{d}d" for d in WINDOWS]
)

VOC_FEATURES = ["num_interactions", "voc_count", "non_voc_count", "voc_ratio"] + _windowed(
    "interactions", "voc", "non_voc", "voc_ratio"
)

GRANULAR_FEATURES = [
    "recent_90d_activity_ratio", "recent_30d_activity_ratio", "activity_density",
    "confirmation_rate_change", "cancellation_rate_change", "voc_to_work_ratio",
    "recent_30d_to_90d_ratio",
]

# Inputs of derived features only; the model never sees them.
HELPER_FEATURES = ["work_span_days", "confirmed_work", "work_count"]

# 57 model features, in scoring order.
MODEL_FEATURES = [
    f for f in WORK_FEATURES + CSI_FEATURES + VOC_FEATURES + GRANULAR_FEATURES if f not in HELPER_FEATURES
]

COUNT_FEATURES = [
    f
    for f in MODEL_FEATURES
    if not any(part in f for part in ("rate", "ratio", "score", "density", "avg"))
]


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Fixed schemas are checked when a table is loaded, not guessed later."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df.select(*columns)
