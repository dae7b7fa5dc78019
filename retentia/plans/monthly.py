"""The monthly customer run: one lazy plan per stored table.

Customers are processed together; there is no chunk loop.  The feature table is
the shared input of scoring, explanation and storage.
"""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators import churn, contracts, explain, features, keys, profile
from retentia.operators.groups import MAX_ITEMS, Children, nest, pack
from retentia.schemas import CONTRACT_FIELDS, MODEL_FEATURES, PROFILE_FIELDS, PURCHASE_FIELDS
from retentia.sources import sinks


def active_customers(customers: DataFrame, contract_rows: DataFrame, as_of: date, **rules) -> DataFrame:
    """Customers with their status, only the active ones."""
    rule = rules.pop("rule", "any")
    resolved = contracts.resolve_contracts(contract_rows, as_of, **rules)
    status = contracts.customers_with_status(customers, contracts.customer_activity(resolved, as_of, rule))
    return status.where("status = 1")


def nested_works(works: DataFrame, services: DataFrame, surveys: DataFrame, limit: int = MAX_ITEMS) -> DataFrame:
    """Work history of a customer as one nested array (several parts if huge)."""
    children = [
        Children(services, "services", ["target", "class", "done"], ["target", "class"]),
        Children(surveys, "surveys", ["survey_date", "survey_code", "csi_score"], ["survey_date", "survey_code"]),
    ]
    full = nest(works, ["work_no"], children, limit).drop("part")
    element = ["work_no", "work_at", "work_type", "confirmed", "cancelled", "services", "surveys"]
    weight = 1 + F.size("services") + F.size("surveys")
    return pack(Children(full, "works", element, ["work_at", "work_no"], weight), ["ccod"], limit)


def snapshot(
    customers: DataFrame,
    contract_rows: DataFrame,
    purchases: DataFrame,
    interactions: DataFrame,
    month: date,
    limit: int = MAX_ITEMS,
) -> DataFrame:
    """Nested monthly snapshot: profile and lists as JSON, ``[]`` when empty."""
    def columns(rows: DataFrame) -> list[str]:
        return [c for c in rows.columns if c != "ccod"]

    children = [
        Children(contract_rows, "contract_info", columns(contract_rows), ["contract_date", "contract_no"]),
        Children(purchases, "purchase_logs", columns(purchases), columns(purchases)),
        Children(interactions, "interaction_history", columns(interactions), columns(interactions)),
    ]
    rows = nest(customers, ["ccod"], children, limit)
    known = [F.col(f) if f in customers.columns else F.lit("").alias(f) for f in PROFILE_FIELDS]
    keep = {"ignoreNullFields": "false"}
    return rows.select(
        "ccod", "part", F.lit(month.replace(day=1)).alias("snapshot_month"),
        F.to_json(F.struct(*known), keep).alias("user_information"),
        *[F.to_json(c, keep).alias(c) for c in ("contract_info", "purchase_logs", "interaction_history")],
    )


def read_lists(rows: DataFrame) -> DataFrame:
    """Snapshot JSON back as arrays; anything unreadable is an empty list."""
    def parsed(column: str, ddl: str):
        return F.coalesce(F.from_json(column, f"array<{ddl}>"), F.array().cast(f"array<{ddl}>")).alias(column)

    return rows.select(
        "ccod", "part", "snapshot_month", F.from_json("user_information", "biz_type string").alias("user_information"),
        parsed("contract_info", CONTRACT_FIELDS), parsed("purchase_logs", PURCHASE_FIELDS),
    )


def cluster_profiles(recommended: DataFrame, snapshots: DataFrame, month: date) -> DataFrame:
    """Cluster profiles from two stored month partitions.

    Both sides are pruned to the month before they are joined.
    """
    first = F.lit(month.replace(day=1))
    mine = recommended.where(F.col("snapshot_month") == first).select("ccod", F.col("user_cluster").alias("cluster"))
    lists = read_lists(snapshots.where(F.col("snapshot_month") == first)).drop("snapshot_month")
    rows = mine.join(lists, "ccod", "left")
    members = rows.groupBy("cluster", "ccod").agg(
        F.max("user_information.biz_type").alias("biz_type"),
        F.sum(F.coalesce(F.size("contract_info"), F.lit(0))).alias("n_contracts"),
        F.sum(F.coalesce(F.size("purchase_logs"), F.lit(0))).alias("n_purchases"),
    )
    held = rows.select("cluster", F.explode("contract_info.target").alias("target"))
    bought = rows.select("cluster", F.explode("purchase_logs.service_name").alias("service_name"))
    # The first element of a list is the earliest contract; of several parts,
    # the earliest of their first elements.
    firsts = (
        rows.where(F.size("contract_info") > 0)
        .groupBy("cluster", "ccod")
        .agg(F.min_by(F.col("contract_info")[0]["target"],
                      F.struct(F.col("contract_info")[0]["contract_date"], F.col("contract_info")[0]["contract_no"])).alias("target"))
    )
    return profile.cluster_profile(members, held, bought, firsts, first)


def score_customers(
    model: PipelineModel, means: dict[int, dict[str, float]], feature_rows: DataFrame, month: date
) -> DataFrame:
    """Stored churn predictions of the feature table."""
    return churn.predict_churn(
        model, feature_rows, F.lit(month.replace(day=1)), means.get(0, {}), means.get(1, {})
    )


def train(feature_rows: DataFrame, min_work: int = 5, rule: dict[str, int] | None = None, **settings):
    """Model and class means from the stored features."""
    rows = features.training_rows(feature_rows, min_work, rule)
    model = churn.fit_churn(rows, **settings)
    means = explain.mean_maps(explain.class_means(rows, "churn", MODEL_FEATURES), "churn", MODEL_FEATURES)
    return model, means


def store(predictions: DataFrame, properties: DataFrame, folder: str) -> None:
    """Writes both outputs of the scoring; they must cover the same customers."""
    keys.require_same_keys(predictions, properties)
    sinks.write_months(predictions, f"{folder}/churn_prediction", mode="overwrite")
    sinks.write_months(properties, f"{folder}/monthly_property", mode="overwrite")
