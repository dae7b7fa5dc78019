"""The recommendation run: fit and publish a version, then score customers or prospects with it.

A version holds the scoring pipeline and all that a recommendation is made of:
the members of each cluster with their lists, and the rated offers.  Scoring
reads those; nothing is fitted, joined or counted again.
"""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions import places
from retentia.operators import keys, neighbors, segment_model
from retentia.operators.groups import join_back, top_per_group
from retentia.operators.recommend import CANDIDATES, CONTRACT_REASON, PRODUCT_REASON, first_contract, offers, wide_offers
from retentia.schemas import PROSPECT_COLUMNS, require_columns
from retentia.session import materialise
from retentia.sources import sinks
from retentia.sources.artifacts import ArtifactStore, Version

MEMBERS, CONTRACT_OFFERS, PRODUCT_OFFERS = "members", "contract_offers", "product_offers"
# Fields a prospect must have to be scored.
REQUIRED = ["bzno", "enp_nm", "rdnm_addr"]
PROSPECT_KEY = ["kedcd", "bzpl_cd", "bzpl_seq"]


def located(rows: DataFrame, address: str, industries: DataFrame | None = None, industry: str = "industry_code") -> DataFrame:
    """Province, district, the four classes and the kind of business of raw rows.

    A province and district that the rows have already are kept.
    ``industries``: code, name and the four classes.  Without it the rows have
    the classes already.  A missing value stays null, which the codes know as
    "Unknown".
    """
    found = {"sido": places.province(F.col(address)), "sigungu": places.district(F.col(address))}
    placed = rows.withColumns({c: v for c, v in found.items() if c not in rows.columns})
    if industries is not None:
        named = industries.withColumnRenamed("code", industry).withColumnRenamed("name", "industry_name")
        placed = placed.join(named, industry, "left")
    name = F.col("industry_name") if "industry_name" in placed.columns else F.lit(None).cast("string")
    return placed.withColumn("biz_type", places.business_type(F.col("class_major"), F.col("class_mid"), name))


def _held(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """How often each customer holds each item, with the customer's cluster; written once for rates and lists."""
    counts = rows.where(F.col("item").isNotNull()).groupBy("ccod", "item").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts.join(clusters, "ccod"), "held")


def _rated(held: DataFrame, clusters: DataFrame) -> DataFrame:
    """The most frequent items of every cluster and the share of members that hold them."""
    counts = held.groupBy("cluster", "item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("holders"))
    best = top_per_group(counts, ["cluster"], [F.desc("n"), F.asc("item")], CANDIDATES)
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    rate = (F.col("holders") / F.col("members") * 100).alias("usage_rate")
    return best.join(sizes, "cluster").select("cluster", "item", "rank", rate)


def _lists(held: DataFrame, into: str) -> DataFrame:
    """The items of a customer as JSON text; as long as the catalogue at most."""
    return held.groupBy("ccod").agg(F.to_json(F.sort_array(F.collect_list("item"))).alias(into))


def write_members(version: Version, scorer: PipelineModel, customers: DataFrame, contracts: DataFrame, products: DataFrame) -> None:
    """Members, their lists and the offers of every cluster, as tables of the version.

    ``customers`` as for the fit, with ``ccod`` and ``name``, one row per
    customer; ``contracts``, ``products``: ccod, item.
    """
    scored = materialise(scorer.transform(customers).select("ccod", "name", "cluster", "vec"), "scored")
    clusters = scored.select("ccod", "cluster")
    members = scored
    for rows, into, offered in ((contracts, "contracts", CONTRACT_OFFERS), (products, "products", PRODUCT_OFFERS)):
        held = _held(rows, clusters)
        version.write(_rated(held, clusters), offered)
        members = members.join(_lists(held, into), "ccod", "left")
    version.write(members, MEMBERS)


def train(store: ArtifactStore, customers: DataFrame, contracts: DataFrame, products: DataFrame, **settings) -> Version:
    """Fits, writes and publishes a version; until the last step readers keep the one before."""
    version = store.begin()
    write_members(version, segment_model.fit(customers, version, **settings), customers, contracts, products)
    store.publish(version)
    return version


def score(version: Version, rows: DataFrame, kept: list[str], month: date, exclude_self: bool = False) -> DataFrame:
    """The recommendation of every row: ``kept``, the first of which is a unique key, and the stored columns.

    ``rows`` has the columns of the fit and may have ``first_target``, an item
    that isn't offered.  The nearest member of the cluster may be the customer
    itself unless ``exclude_self``.  The number of clusters is that of the
    version's centres, so offers are a short broadcast at any size.
    """
    key = kept[0]
    if "first_target" not in rows.columns:
        rows = rows.withColumn("first_target", F.lit(None).cast("string"))
    scored = version.model(segment_model.PIPELINE).transform(rows)
    scored = materialise(scored.select(*kept, "first_target", "cluster", "similarity", "vec"), "scored")
    members = version.table(MEMBERS)
    near = neighbors.nearest_in_cluster(
        scored.select(F.col(key).alias("id"), "cluster", "vec"), members.select(F.col("ccod").alias("id"), "cluster", "vec"),
        exclude_self=exclude_self,
    )
    near = materialise(near.select(F.col("id").alias(key), F.col("neighbor_id").alias("sim_ccod")), "near")
    # One row per peer; many rows may share one.
    peers = near.groupBy("sim_ccod").agg(F.count(F.lit(1)).alias("_rows"))
    listed = members.select(F.col("ccod").alias("sim_ccod"), F.col("name").alias("sim_user_name"), "contracts", "products")
    listed = materialise(peers.join(listed, "sim_ccod"), "peers")
    chosen = offers(scored, version.table(CONTRACT_OFFERS), "first_target").withColumnRenamed("offers", "contract_offers")
    chosen = offers(chosen, version.table(PRODUCT_OFFERS)).withColumnRenamed("offers", "product_offers")
    joined = join_back(chosen.join(near, key, "left"), listed, ["sim_ccod"])

    def text(column: str, default: str = "") -> Column:
        return F.coalesce(column, F.lit(default))

    return joined.select(
        *kept, F.lit(month.replace(day=1)).alias("snapshot_month"), F.col("cluster").alias("user_cluster"),
        F.col("similarity").alias("cluster_similarity"), text("sim_ccod").alias("sim_ccod"), text("sim_user_name").alias("sim_user_name"),
        text("contracts", "[]").alias("sim_user_contracts"), text("products", "[]").alias("sim_user_products"),
        *wide_offers("contract", CONTRACT_REASON, F.col("contract_offers")),
        *wide_offers("product", PRODUCT_REASON, F.col("product_offers")),
    )


def recommend_customers(version: Version, customers: DataFrame, contract_rows: DataFrame, month: date, **options) -> DataFrame:
    """Stored recommendations of existing customers; their first contract isn't offered again."""
    firsts = first_contract(contract_rows)
    return score(version, customers.join(firsts, "ccod", "left"), ["ccod"], month, **options)


def ingest_prospects(scan: DataFrame, path: str, month: date, since: date) -> int:
    """Appends the prospects registered since a day to the month's partition; returns how many were new.

    ``scan`` has the stored columns but the month, and ``registered_at``.  Only
    rows whose key the month doesn't hold yet are written, one per key, so a
    repeated run adds none; what an interrupted one wrote is found there.
    """
    first = month.replace(day=1)
    recent = scan.where(F.col("registered_at") >= F.lit(since)).withColumn("snapshot_month", F.lit(first))
    rows = require_columns(recent, PROSPECT_COLUMNS, "prospects").dropDuplicates(PROSPECT_KEY)
    spark = scan.sparkSession
    if sinks.exists(spark, f"{path}/snapshot_month={first}"):
        known = spark.read.parquet(path).where(F.col("snapshot_month") == F.lit(first)).select(*[F.col(k).alias(f"_{k}") for k in PROSPECT_KEY])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PROSPECT_KEY]
        rows = rows.join(known, same, "left_anti")
    new = materialise(rows, "prospects")
    count = new.count()
    if count:
        sinks.write_months(new, path)
    return count


def stored_prospects(scan: DataFrame, path: str) -> DataFrame:
    """The stored table; one without rows if nothing was stored yet.  ``scan`` has its columns."""
    spark = scan.sparkSession
    if sinks.exists(spark, path):
        return spark.read.parquet(path)
    return scan.limit(0).withColumn("snapshot_month", F.lit(None).cast("date")).select(*PROSPECT_COLUMNS)


def recommend_prospects(version: Version, prospects: DataFrame, customers: DataFrame, industries: DataFrame, month: date) -> DataFrame:
    """Recommendations of complete prospects that aren't customers, by business number.

    ``prospects`` is the stored table, pruned to the month; of several sites
    with one business number the first by key counts.  ``customers``: biz_no.
    """
    mine = prospects.where(F.col("snapshot_month") == F.lit(month.replace(day=1))).drop("snapshot_month")
    eligible = keys.eligible_prospects(mine, customers, REQUIRED)
    one = F.min_by(F.struct(*[c for c in eligible.columns if c != "bzno"]), F.struct(*PROSPECT_KEY))
    sites = eligible.groupBy("bzno").agg(one.alias("s")).select("bzno", "s.*")
    rows = located(sites, "rdnm_addr", industries, "bf_bzc_cd")
    rows = rows.withColumnsRenamed({"lot": "lon", "lsze_metr": "area"})
    return score(version, rows, ["bzno", "enp_nm", *PROSPECT_KEY], month)


def store_months(rows: DataFrame, path: str) -> None:
    """Replaces the month of the rows in a table of recommendations."""
    sinks.write_months(rows, path, mode="overwrite")


def open_store(spark: SparkSession, root: str) -> ArtifactStore:
    return ArtifactStore(spark, root)
