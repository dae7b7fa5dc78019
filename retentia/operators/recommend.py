"""What to offer a customer: usage in the segment, nearest peer, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.dates import LAST_VALID, parse_date
from retentia.operators.groups import join_back, top_per_group
from retentia.operators.profile import top_values
from retentia.session import materialise

CANDIDATES, OFFERS = 10, 3
CONTRACT_REASON = "고객 세그먼트 내 %.1f%%가 이용중"
PRODUCT_REASON = "고객 세그먼트 내 %.1f%%가 구매함"


def candidates(rows: DataFrame, value: str, k: int = CANDIDATES) -> DataFrame:
    """The items of a cluster that may be offered, most frequent first."""
    return top_values(rows, value, k).select("cluster", F.col("value").alias("item"), "rank")


def usage_rate(holdings: DataFrame, members: DataFrame) -> DataFrame:
    """Members holding an item per hundred members, once per cluster and item.

    ``holdings``: cluster, ccod, item.  ``members``: cluster, ccod.
    """
    holders = holdings.groupBy("cluster", "item").agg(F.countDistinct("ccod").alias("holders"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return holders.join(sizes, "cluster").withColumn("usage_rate", F.col("holders") / F.col("members") * 100)


def rated_candidates(cands: DataFrame, usage: DataFrame) -> DataFrame:
    rated = cands.join(usage.select("cluster", "item", "usage_rate"), ["cluster", "item"], "left")
    return rated.withColumn("usage_rate", F.coalesce("usage_rate", F.lit(0.0)))


def first_contract(contracts: DataFrame) -> DataFrame:
    """Target of each customer's earliest dated contract; unreadable dates last."""
    dated = contracts.where((F.col("target") != "") & (F.col("contract_date") != ""))
    at = F.coalesce(parse_date(F.col("contract_date")), F.lit(LAST_VALID).cast("timestamp"))
    order = F.struct(at, F.col("contract_no"))
    return dated.groupBy("ccod").agg(F.min_by("target", order).alias("first_target"))


def offer_table(rated: DataFrame) -> DataFrame:
    """Candidates of a cluster as one sorted array of at most ten structs."""
    item = F.struct((-F.col("usage_rate")).alias("o"), "rank", "item", "usage_rate")
    return rated.groupBy("cluster").agg(F.sort_array(F.collect_list(item)).alias("offers"))


def offers(customers: DataFrame, rated: DataFrame, exclude: str | None = None, keep: int = OFFERS) -> DataFrame:
    """The best offers of every customer, skipping one item they started with.

    ``customers``: ccod, cluster and the ``exclude`` column.  The candidates
    are one short array per cluster, so each customer's choice is made inside
    its row.
    """
    # One short row per cluster, so the customers need not move.
    joined = customers.join(F.broadcast(offer_table(rated)), "cluster", "left")
    choice = F.col("offers")
    if exclude is not None:
        choice = F.filter(choice, lambda o: ~o["item"].eqNullSafe(F.col(exclude)))
    return joined.withColumn("offers", F.slice(choice, 1, keep))


def wide_offers(name: str, reason: str, offers_column: Column, keep: int = OFFERS) -> list[Column]:
    """``rec_<name>_i`` and its reason text; empty text where nothing is left."""
    out = []
    for i in range(keep):
        o = F.get(offers_column, F.lit(i))
        out.append(F.coalesce(o["item"], F.lit("")).alias(f"rec_{name}_{i + 1}"))
        out.append(
            F.when(o.isNotNull(), F.format_string(reason, o["usage_rate"])).otherwise("").alias(f"rec_{name}_{i + 1}_reason")
        )
    return out


def distinct_list(rows: DataFrame, value: str, into: str) -> DataFrame:
    """Sorted distinct values per customer as JSON text.

    The list is as long as the catalogue at most, however many rows there are.
    """
    return rows.groupBy("ccod").agg(F.to_json(F.sort_array(F.collect_set(value))).alias(into))


def recommendations(
    customers: DataFrame,
    neighbors: DataFrame,
    members: DataFrame,
    contracts: DataFrame,
    products: DataFrame,
    snapshot_month: Column,
) -> DataFrame:
    """The stored recommendation of every customer.

    ``customers``: ccod, cluster, similarity, first_target;
    ``neighbors``: ccod, sim_ccod; ``members``: ccod, name, cluster;
    ``contracts``, ``products``: ccod, item of the members.
    """
    held = members.select("ccod", "cluster")
    contract_rows, product_rows = (t.join(held, "ccod") for t in (contracts, products))
    rated_c = rated_candidates(candidates(contract_rows, "item"), usage_rate(contract_rows, held))
    rated_p = rated_candidates(candidates(product_rows, "item"), usage_rate(product_rows, held))
    chosen = offers(customers, rated_c, "first_target").withColumnRenamed("offers", "contract_offers")
    chosen = offers(chosen, rated_p).withColumnRenamed("offers", "product_offers")

    # One row per peer; many customers may share one.
    peers = neighbors.groupBy(F.col("sim_ccod").alias("ccod")).agg(F.count(F.lit(1)).alias("_rows"))
    lists = peers.join(members.select("ccod", F.col("name").alias("sim_user_name")), "ccod", "left")
    for rows, into in ((contracts, "sim_user_contracts"), (products, "sim_user_products")):
        wanted = rows.join(peers, "ccod", "left_semi")
        lists = lists.join(distinct_list(wanted, "item", into), "ccod", "left")
    lists = materialise(lists.withColumnRenamed("ccod", "sim_ccod"), "peers")
    return (
        join_back(chosen.join(neighbors, "ccod", "left"), lists, ["sim_ccod"])
        .select(
            "ccod",
            snapshot_month.alias("snapshot_month"),
            F.col("cluster").alias("user_cluster"),
            F.col("similarity").alias("cluster_similarity"),
            F.coalesce("sim_ccod", F.lit("")).alias("sim_ccod"),
            F.coalesce("sim_user_name", F.lit("")).alias("sim_user_name"),
            F.coalesce("sim_user_contracts", F.lit("[]")).alias("sim_user_contracts"),
            F.coalesce("sim_user_products", F.lit("[]")).alias("sim_user_products"),
            *wide_offers("contract", CONTRACT_REASON, F.col("contract_offers")),
            *wide_offers("product", PRODUCT_REASON, F.col("product_offers")),
        )
    )


def best_of(rows: DataFrame, keys: list[str], k: int = OFFERS) -> DataFrame:
    """Top k by usage rate, then candidate order."""
    return top_per_group(rows, keys, [F.desc("usage_rate"), F.asc("rank")], k, "place")
