"""The engine's domain tables, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.dates import OPEN_ENDED


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(column: str) -> Column:
    return F.col(column).cast("string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (
        c.join(n, "c_nationkey").join(r, "n_regionkey")
        .select(
            _code("c_custkey").alias("ccod"), F.col("c_name").alias("name"),
            F.col("r_name").alias("type_major"), F.col("n_name").alias("type_mid"),
            F.col("c_mktsegment").alias("biz_type"), F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("number"),
        )
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as yearly contracts; dates are texts, as in the sources."""
    o = load(spark, sf_dir, "orders")
    status, key, start = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = "yyyyMMdd"
    open_end = (status == "P") & (key % 7 == 0)
    return o.select(
        _code("o_custkey").alias("ccod"), key.cast("string").alias("contract_no"),
        F.col("o_orderpriority").alias("target"),
        F.date_format(start, text).alias("contract_date"), F.date_format(start, text).alias("start_date"),
        F.when(open_end, OPEN_ENDED).otherwise(F.date_format(F.date_add(start, 365), text)).alias("end_date"),
        F.when(status == "F", F.date_format(F.date_add(start, (key % 365).cast("int")), text)).alias("cancel_date"),
        F.when(status == "F", "Y").when(status == "P", "false").otherwise("TRUE").alias("cancelled"),
        F.lit(None).cast("string").alias("cancel_no"), F.col("o_totalprice").alias("area"),
    )


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as works of the order's customer."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    surveyed = F.col("l_returnflag") != "N"
    return load(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(
        _code("o_custkey").alias("ccod"), F.col("l_shipdate").alias("work_at"),
        F.col("l_linenumber").cast("string").alias("work_type"),
        (F.col("l_linestatus") == "F").alias("confirmed"), (F.col("l_returnflag") == "R").alias("cancelled"),
        F.col("l_quantity").cast("bigint").alias("n_services"),
        F.when(surveyed, F.round(F.col("l_discount") * 100)).otherwise(0.0).alias("csi_sum"),
        surveyed.cast("int").alias("csi_count"),
    )


def work_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works; their line items are services and surveys."""
    return load(spark, sf_dir, "orders").select(
        _code("o_orderkey").alias("work_no"), _code("o_custkey").alias("ccod"),
        F.col("o_orderdate").alias("work_at"), F.col("o_orderpriority").alias("work_type"),
        (F.col("o_orderstatus") == "F").alias("confirmed"), (F.col("o_orderstatus") == "P").alias("cancelled"),
    )


def work_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        _code("l_orderkey").alias("work_no"), F.concat(F.lit("P"), "l_partkey").alias("target"),
        F.col("l_linenumber").cast("string").alias("class"), (F.col("l_linestatus") == "F").alias("done"),
    )


def work_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as surveys; some scores are not numbers."""
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    quantity = F.col("l_quantity").cast("int")
    score = F.when(quantity % 10 == 0, "n/a").otherwise(quantity.cast("string"))
    return rows.select(
        _code("l_orderkey").alias("work_no"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("survey_date"),
        F.concat(F.lit("Q"), "l_linenumber").alias("survey_code"), score.alias("csi_score"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        _code("o_custkey").alias("ccod"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "VOC").otherwise("CALL").alias("event_type"),
        F.col("o_orderdate").alias("event_at"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(o, "l_orderkey").join(p, "l_partkey")
        .select(_code("o_custkey").alias("ccod"), F.col("p_brand").alias("service_name"))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(load(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ccod"), F.col("ts").alias("created_at"),
        F.concat(F.lit("R"), F.floor(F.col("event_id") / 3)).alias("rcno"),
    )


def event_number() -> Column:
    """The number inside an event's JSON properties."""
    return F.get_json_object("props", "$.k").cast("int")


def message_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_category_of(load(spark, sf_dir, "events"))


def message_category_of(events: DataFrame) -> DataFrame:
    """Events as classified messages with up to five category codes."""
    return events.select(*_category_columns())


def _category_columns() -> list[Column]:
    k = event_number()
    return [
        F.col("event_id").alias("msg_id"),
        (F.col("value") >= 20).cast("int").alias("is_claim"),
        F.col("event_type").alias("detail_category_1_code"),
        F.when(k % 2 == 0, F.concat(F.lit("D"), k % 5)).alias("detail_category_2_code"),
        F.when(k % 3 == 0, F.concat(F.lit("E"), k % 4)).alias("detail_category_3_code"),
        F.lit(None).cast("string").alias("detail_category_4_code"),
        F.when(k % 11 == 0, F.col("event_type")).alias("detail_category_5_code"),
        F.when(F.col("event_type") == "error", "기타").otherwise(F.col("event_type")).alias("main_category_1_name"),
        ((F.col("value") % 100) / 100).alias("model_confidence"),
        F.col("ts").alias("created_at"),
        F.when(k % 10 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("updated_at"),
    ]


def customer_categories_of(events: DataFrame) -> DataFrame:
    """Events as classified messages with their customer."""
    return events.select(*_category_columns(), F.col("user_id").cast("string").alias("ccod"))


def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the event categories; one code has none."""
    return (
        load(spark, sf_dir, "events").select("event_type").distinct()
        .where("event_type <> 'view'")
        .select(F.col("event_type").alias("voc_id"), F.upper("event_type").alias("name"))
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and supplier as the three levels.

    The last child of every parent, and the last region, is the "other" entry.
    """
    r, n, s = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))

    def level(rows: DataFrame, depth: int, mark: str, key: str, name: str, parent: Column, offset: int) -> DataFrame:
        named = rows.select(
            F.concat(F.lit(mark), key).alias("voc_id"), F.col(name).alias("name"), parent.alias("parent_id"),
            F.lit(float(depth)).alias("level"), (F.col(key) + offset).cast("bigint").alias("id"),
        )
        last = named.groupBy("parent_id").agg(F.max("id").alias("last"))
        return (
            named.join(last.withColumnRenamed("parent_id", "p"), F.col("parent_id").eqNullSafe(F.col("p")))
            .withColumn("name", F.when(F.col("id") == F.col("last"), "기타").otherwise(F.col("name")))
            .select("id", "voc_id", "name", "parent_id", "level")
        )

    l1 = level(r, 1, "L", "r_regionkey", "r_name", F.lit(None).cast("string"), 0)
    l2 = level(n, 2, "M", "n_nationkey", "n_name", F.concat(F.lit("L"), "n_regionkey"), 100)
    l3 = level(s, 3, "S", "s_suppkey", "s_name", F.concat(F.lit("M"), "s_nationkey"), 1000)
    return l1.unionByName(l2).unionByName(l3)


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages whose first five line items are the named categories.

    The supplier's region, nation and name are the category path; some names
    are unknown, missing or belong to another parent.
    """
    li = load(spark, sf_dir, "lineitem").where("l_linenumber <= 5")
    picked = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.struct("l_suppkey", "l_quantity")).alias("x")
    ).select("l_orderkey", "l_linenumber", F.col("x.l_suppkey").alias("s_suppkey"), F.col("x.l_quantity").cast("int").alias("q"))
    path = (
        load(spark, sf_dir, "supplier")
        .join(load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        .join(load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
        .select("s_suppkey", "s_name", "n_name", "r_name")
    )
    q = F.col("q")
    item = F.struct(
        "l_linenumber",
        F.when(q % 17 == 0, None).when(q % 13 == 0, "nowhere").otherwise(F.col("r_name")).alias("major"),
        F.when(q % 11 == 0, "NATION_0").when(q % 19 == 0, "").otherwise(F.col("n_name")).alias("mid"),
        F.when(q % 10 == 0, "nobody").otherwise(F.col("s_name")).alias("minor"),
        F.concat(F.lit("q"), q).alias("reason"),
    )
    return (
        picked.join(path, "s_suppkey")
        .groupBy(F.col("l_orderkey").alias("msg_id"))
        .agg(F.sort_array(F.collect_list(item)).alias("c"))
        .select(
            "msg_id",
            F.transform("c", lambda x: F.struct(
                x["major"].alias("major"), x["mid"].alias("mid"), x["minor"].alias("minor"), x["reason"].alias("reason")
            )).alias("categories"),
        )
    )


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vec")
    )


def customer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the market segment as their cluster."""
    return load(spark, sf_dir, "customer").select(
        _code("c_custkey").alias("ccod"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cluster")
    )


def segment_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with places and classes derived from their columns; some details and numbers are missing."""
    c = customers(spark, sf_dir)
    return c.select(
        "ccod", "name", F.col("type_major").alias("class_major"), F.col("type_mid").alias("class_mid"),
        F.col("biz_type").alias("class_minor"), F.when(F.col("number") % 7 != 0, F.col("name")).alias("class_detail"),
        F.col("type_major").alias("sido"), F.col("type_mid").alias("sigungu"), "biz_type",
        F.when(F.col("nation") != 3, 33 + F.col("nation") / 5).alias("lat"), (126 + F.col("nation") % 4).alias("lon"),
        F.when(F.col("balance") > 0, F.col("balance")).alias("area"),
        F.when(F.col("number") % 3 == 0, F.col("number").cast("string")).alias("biz_no"),
    )


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as industry codes, with their classes."""
    n = load(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return n.join(load(spark, sf_dir, "region"), "r_regionkey").select(
        F.concat(F.lit("I"), "n_nationkey").alias("code"), F.concat(F.lit("industry "), "n_name").alias("name"),
        F.col("r_name").alias("class_major"), F.col("n_name").alias("class_mid"),
        F.lit(None).cast("string").alias("class_minor"), F.lit(None).cast("string").alias("class_detail"),
    )


def prospect_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites of prospective customers, registered over two months; some fields are missing."""
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    key = F.col("s_suppkey")
    return s.join(n, "s_nationkey").join(r, "n_regionkey").select(
        _code("s_suppkey").alias("kedcd"), F.lit("1").alias("bzpl_cd"), (key % 2).cast("string").alias("bzpl_seq"),
        # Two sites share a business number.
        (key - key % 2).cast("string").alias("bzno"), F.when(key % 10 != 4, F.col("s_name")).alias("enp_nm"),
        F.col("r_name").alias("sido"), F.col("n_name").alias("sigungu"),
        (33 + F.col("s_nationkey") / 5).alias("lat"), F.when(key % 9 != 0, 126 + F.col("s_nationkey") % 4).alias("lot"),
        F.col("s_name").alias("bzpl_nm"), F.concat(F.lit("I"), "s_nationkey").alias("bf_bzc_cd"),
        F.lit(None).cast("double").alias("bsze_metr"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("lsze_metr"),
        F.concat_ws(" ", "r_name", "n_name").alias("rdnm_addr"),
        F.date_add(F.lit("2023-11-15").cast("date"), (key % 60).cast("int")).alias("registered_at"),
    )
