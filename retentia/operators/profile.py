"""What a cluster's members have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators.groups import top_per_group

TOP = 5


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Distinct customers and mean list lengths.

    ``members``: cluster, ccod, n_contracts, n_purchases.
    """
    return members.groupBy("cluster").agg(
        F.countDistinct("ccod").alias("cluster_size"),
        F.avg(F.coalesce("n_contracts", F.lit(0))).alias("avg_contracts_num"),
        F.avg(F.coalesce("n_purchases", F.lit(0))).alias("avg_purchase_num"),
    )


def top_values(rows: DataFrame, value: str, k: int = TOP) -> DataFrame:
    """The k most frequent values of every cluster; names in order break ties."""
    counts = (
        rows.where(F.col(value).isNotNull())
        .groupBy("cluster", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, ["cluster"], [F.desc("n"), F.asc("value")], k)


def top_values_with_share(rows: DataFrame, members: DataFrame, value: str, k: int = TOP) -> DataFrame:
    """As ``top_values``, with occurrences per hundred members."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    top = top_values(rows, value, k).join(sizes, "cluster")
    return top.withColumn("percentage", F.col("n") / F.col("members") * 100)


def length_distribution(members: DataFrame, length: str) -> DataFrame:
    """Customers per list length; empty lists are not counted."""
    return (
        members.where(F.col(length) > 0)
        .groupBy("cluster", F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("customers"))
    )


def as_list(top: DataFrame, into: str) -> DataFrame:
    """Top values of a cluster as one array of at most k names."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "value")))
    return top.groupBy("cluster").agg(F.transform(ordered, lambda x: x["value"]).alias(into))


def as_map(distribution: DataFrame, into: str) -> DataFrame:
    """Distribution of a cluster as one map, keyed by length."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("length").cast("string"), "customers")))
    return distribution.groupBy("cluster").agg(F.map_from_entries(entries).alias(into))


def cluster_profile(
    members: DataFrame, contracts: DataFrame, purchases: DataFrame, first_contracts: DataFrame, snapshot_month: Column
) -> DataFrame:
    """One row per cluster, as stored.

    ``members``: cluster, ccod, biz_type, n_contracts, n_purchases;
    ``contracts``, ``first_contracts``: cluster, target;
    ``purchases``: cluster, service_name.
    """
    profile = cluster_sizes(members)
    for part in (
        as_list(top_values(contracts, "target"), "top_contracts"),
        as_list(top_values(purchases, "service_name"), "top_purchases"),
        as_list(top_values(members, "biz_type"), "top_business_type"),
        as_list(top_values(first_contracts, "target"), "top_first_contract_code"),
        as_map(length_distribution(members, "n_contracts"), "contracts_distribution"),
        as_map(length_distribution(members, "n_purchases"), "purchase_distribution"),
    ):
        profile = profile.join(part, "cluster", "left")
    lists = ["top_contracts", "top_purchases", "top_business_type", "top_first_contract_code"]
    return profile.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}).withColumn(
        "snapshot_month", snapshot_month
    )


