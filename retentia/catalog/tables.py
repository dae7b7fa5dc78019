"""Scans, projections, nested tables, dates and sinks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.catalog.registry import query, rounded, sql_round, whole
from retentia.functions import dates as D
from retentia.functions.numbers import messy_boolean
from retentia.functions.text import canonical_category
from retentia.operators import contracts as C
from retentia.operators import features as X
from retentia.operators import messages as M
from retentia.operators import taxonomy
from retentia.plans import examples, hourly, monthly
from retentia.session import scratch_dir
from retentia.sources import adapters as A
from retentia.sources import readers, sinks

MONTH = date(2024, 1, 1)

# --- projections and filters -------------------------------------------------


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS ccod, o_orderpriority AS target, CAST(o_orderstatus = 'F' AS BIGINT) AS confirmed,
    'voc-classifier' AS model_name, CAST(o_totalprice AS BIGINT) // 1 AS price FROM (
      SELECT o_custkey, o_orderpriority, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders
      WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderpriority <> '5-LOW')"""
)
def domain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "orders").where(
        readers.between("o_orderdate", datetime(1998, 1, 1), datetime(1999, 1, 1)) & (F.col("o_orderpriority") != "5-LOW")
    )
    named = readers.renamed(
        rows, {"o_custkey": "ccod", "o_orderpriority": "target", "o_orderstatus": "status", "o_totalprice": "price"}
    )
    return named.select(
        F.col("ccod").cast("string").alias("ccod"), "target", (F.col("status") == "F").cast("bigint").alias("confirmed"),
        F.lit(M.MODEL_NAME).alias("model_name"), F.floor("price").cast("bigint").alias("price"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 ELSE -1 END AS flag FROM (
       SELECT o_orderkey, o_orderstatus FROM orders)"""
)
def messy_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    text = F.when(status == "F", F.concat(F.lit(" "), F.element_at(F.array(F.lit("t"), F.lit("Y"), F.lit("True"), F.lit("1")), (F.col("o_orderkey") % 4 + 1).cast("int"))))
    text = text.when(status == "P", F.element_at(F.array(F.lit("f"), F.lit("N"), F.lit("FALSE"), F.lit("0")), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise("maybe")
    rows = A.load(spark, sf_dir, "orders").withColumn("flag", messy_boolean(text))
    return rows.select("o_orderkey", F.coalesce(F.col("flag").cast("int"), F.lit(-1)).alias("flag"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '2024_01' AS label,
    strftime(o_orderdate - INTERVAL 9 HOURS + INTERVAL (o_orderkey % 24) HOURS + INTERVAL (o_orderkey % 60) MINUTES, '%Y-%m-%d %H:%M:%S') AS utc,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
    strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
    CAST(o_orderkey % 2 = 0 AS BIGINT) AS is_list, CAST(o_orderkey % 5 = 0 AS BIGINT) AS open_ended
    FROM orders"""
)
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    formats = ["yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss"]
    text = F.element_at(F.array(*[F.date_format(when, f) for f in formats]), (key % 4 + 1).cast("int"))
    hhmm = F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lpad((key % 60).cast("string"), 2, "0"))
    local = D.from_date_and_hhmm(F.date_format(when, "yyyyMMdd"), hhmm)
    listed = F.when(key % 2 == 0, "[1]").when(key % 3 == 0, "x")
    end = F.when(key % 10 == 0, "99991231").when(key % 5 == 0, "9999-12-31").otherwise(text)
    parsed = D.parse_date(text)
    return A.load(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(parsed, "yyyy-MM-dd").alias("day"),
        D.month_label(F.lit(MONTH)).alias("label"),
        F.date_format(D.kst_to_utc(local), "yyyy-MM-dd HH:mm:ss").alias("utc"),
        F.date_format(D.month_start(parsed), "yyyy-MM-dd").alias("month_start"),
        F.date_format(D.next_month(parsed), "yyyy-MM-dd").alias("next_month"),
        (D.json_array_text(listed) == "[1]").cast("bigint").alias("is_list"),
        (D.is_open_ended(end) & D.parse_date(end).isNull()).cast("bigint").alias("open_ended"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(upper(p_name), 'Unknown') AS item_name,
    CASE WHEN p_type = 'PROMO' THEN '해충 문제' ELSE coalesce(p_type, 'none') END AS category
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25"""
)
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.load(spark, sf_dir, "part").where("p_size > 25")
    codes = part.select(F.col("p_partkey").alias("code"), F.upper("p_name").alias("name"))
    kinds = part.select(
        F.col("p_partkey").alias("code"), F.when(F.col("p_type") == "PROMO", "해충").otherwise(F.col("p_type")).alias("name")
    )
    rows = A.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = taxonomy.code_name(rows, codes, "l_partkey", "item_name")
    typed = taxonomy.code_name(named, kinds, "l_partkey", "category", "none")
    return typed.select("l_orderkey", "l_linenumber", "item_name", canonical_category(F.col("category")).alias("category"))


# --- nested tables -----------------------------------------------------------


@query(
    """WITH s AS (SELECT l_orderkey AS k, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT CAST(o_custkey AS VARCHAR) AS ccod, count(*) AS works, CAST(sum(coalesce(n, 0)) AS BIGINT) AS services,
           CAST(sum(coalesce(r, 0)) AS BIGINT) AS surveys, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS numbers
    FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY o_custkey"""
)
def nested_work_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly.nested_works(A.work_headers(spark, sf_dir), A.work_services(spark, sf_dir), A.work_surveys(spark, sf_dir))

    def total(child: str):
        return F.aggregate("works", F.lit(0), lambda a, w: a + F.size(w[child])).cast("bigint")

    return rows.select(
        "ccod", F.size("works").cast("bigint").alias("works"), total("services").alias("services"),
        total("surveys").alias("surveys"), F.array_join(F.col("works.work_no"), "|").alias("numbers"),
    )


SNAPSHOT_SQL = """
WITH c AS (SELECT o_custkey AS k, count(*) AS n, arg_min(o_orderpriority, o_orderdate + INTERVAL 0 DAY) AS t,
           count_if(o_orderpriority = '1-URGENT') AS v FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS ccod, c_name AS name, r_name AS type_major, '' AS ceo, '2024-01-01' AS snapshot_month,
       coalesce(c.n, 0) AS contracts, coalesce(b.n, 0) AS purchases, coalesce(c.n, 0) AS interactions,
       CAST(coalesce(v, 0) AS BIGINT) AS voc
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
     LEFT JOIN c ON c.k = c_custkey LEFT JOIN b ON b.k = c_custkey
"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.interactions(spark, sf_dir).select(
        "ccod", F.date_format("event_at", "yyyy-MM-dd").alias("event_date"), "event_type"
    )
    bought = A.purchases(spark, sf_dir)
    profile = A.customers(spark, sf_dir).select("ccod", "name", "type_major", "type_mid", "biz_type")
    return monthly.snapshot(profile, A.contracts(spark, sf_dir), bought, events, MONTH)


@query(SNAPSHOT_SQL)
def monthly_snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snapshot(spark, sf_dir)

    def info(field: str):
        return F.get_json_object("user_information", f"$.{field}").alias(field)

    events = F.from_json("interaction_history", "array<struct<event_type:string>>")
    return rows.select(
        "ccod", info("name"), info("type_major"), info("ceo"),
        F.date_format("snapshot_month", "yyyy-MM-dd").alias("snapshot_month"),
        F.json_array_length("contract_info").cast("bigint").alias("contracts"),
        F.json_array_length("purchase_logs").cast("bigint").alias("purchases"),
        F.size(events).cast("bigint").alias("interactions"),
        F.size(F.filter(events, lambda e: e["event_type"] == "VOC")).cast("bigint").alias("voc"),
    )


CONTRACT_JSON_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS ccod, CAST(o_orderkey AS VARCHAR) AS contract_no, o_orderpriority AS target,
       strftime(o_orderdate, '%Y%m%d') AS start_date FROM orders
"""


@query(CONTRACT_JSON_SQL)
def contracts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = _snapshot(spark, sf_dir).select("ccod", F.col("contract_info").alias("contracts_info"))
    return C.explode_contracts(snapshot).select("ccod", "contract_no", "target", "start_date")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS ccod, count(*) AS n, CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT) AS voc,
    strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY 1"""
)
def interactions_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.explode_interactions(_snapshot(spark, sf_dir))
    return events.groupBy("ccod").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "VOC").alias("voc"),
        F.date_format(F.max("event_at"), "yyyy-MM-dd").alias("last_day"),
    )


@query(
    """SELECT c_mktsegment AS cluster, count(DISTINCT c_custkey) AS cluster_size, """
    + sql_round("avg(coalesce(n, 0))", "avg_contracts_num")
    + """ FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"""
)
def month_peer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stored month tables, read back by partition."""
    folder = scratch_dir(spark, "months")
    clusters = A.customer_clusters(spark, sf_dir).select("ccod", F.col("cluster").alias("user_cluster"))
    for month in (MONTH, date(2023, 12, 1)):
        stamped = clusters.withColumn("snapshot_month", F.lit(month))
        sinks.write_months(stamped, f"{folder}/recommendation")
    sinks.write_months(_snapshot(spark, sf_dir), f"{folder}/snapshot")
    profiles = monthly.cluster_profiles(
        spark.read.parquet(f"{folder}/recommendation"), spark.read.parquet(f"{folder}/snapshot"), MONTH
    )
    return profiles.select("cluster", *whole("cluster_size"), rounded("avg_contracts_num"))


# --- messages end to end -----------------------------------------------------

RULES = {"the": ("AFRICA", "NATION_0", "x"), "ou": ("ASIA", "NATION_2", ""), "tion": ("nowhere", "NATION_1", "y")}
CLAIM_WORDS = ["zz", "and", "der"]


@query(
    rf"""WITH c AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(regexp_replace(text, '[^가-힣a-zA-Z0-9\s.,!?]', ' ', 'g'), '\s+', ' ', 'g')) AS t
    FROM conversations),
    d AS (SELECT id, trim(regexp_replace(regexp_replace(t, '[.,!?]', '', 'g'), '\s+', ' ', 'g')) AS t FROM c),
    k AS (SELECT id, t, list_filter({list(RULES)}, lambda w: contains(t, w)) AS w FROM d)
    SELECT CAST(id AS BIGINT) AS id, CAST(contains(t, 'zz') OR contains(t, 'and') OR contains(t, 'der') AS BIGINT) AS is_claim,
           array_to_string(w, '|') AS keywords, {sql_round("least(1.0, len(w) / 5)", "confidence")} FROM k"""
)
def message_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = A.load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content")
    )
    scored = M.score_messages(texts, M.keyword_scorer(RULES, CLAIM_WORDS))
    parsed = scored.withColumn("a", F.from_json("answer", "is_claim string, keywords array<string>"))
    return parsed.select(
        "id", (F.col("a.is_claim") == "claim").cast("bigint").alias("is_claim"),
        F.array_join("a.keywords", "|").alias("keywords"), rounded("confidence"),
    )


@query()
def classified_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest, scoring, slots and pest fallback in one plan."""
    source = A.load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("R"), "conv_id", F.lit("-"), "turn").alias("rcno"),
        F.col("conv_id").cast("string").alias("ccod"), F.col("text").alias("content"),
        F.lit(datetime(2024, 1, 1, 10)).alias("inserted_at"),
    )
    now = datetime(2024, 1, 1, 11)
    received = hourly.ingest(source, datetime(2024, 1, 1, 10), now, now)
    return hourly.classify(received, A.taxonomy(spark, sf_dir), M.keyword_scorer(RULES, CLAIM_WORDS), now)


# --- sinks -------------------------------------------------------------------

ROUNDTRIP_SQL = """
SELECT 'append' AS kind, 2 * count(*) AS n, 2 * CAST(sum(c_custkey) AS BIGINT) AS total FROM customer
UNION ALL SELECT 'reload', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'month', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'csv', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'json', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
"""


@query(ROUNDTRIP_SQL)
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "sinks")
    rows = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    for _ in range(2):
        sinks.append(rows, f"{folder}/append")
        sinks.reload(rows, f"{folder}/reload")
        for month in (MONTH, date(2024, 2, 1)):
            stamped = rows.withColumn("snapshot_month", F.lit(month))
            sinks.write_months(stamped, f"{folder}/month", mode="overwrite")
    sinks.export_csv(rows, f"{folder}/csv")
    sinks.export_json_lines(rows, f"{folder}/json")
    ddl = "id bigint, c_name string"
    back = {
        "append": spark.read.parquet(f"{folder}/append"),
        "reload": spark.read.parquet(f"{folder}/reload"),
        "month": readers.month_partition(spark, f"{folder}/month", MONTH),
        "csv": readers.csv_dimension(spark, f"{folder}/csv", ddl),
        "json": spark.read.schema(ddl).json(f"{folder}/json"),
    }
    results = None
    for kind, table in back.items():
        one = table.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).withColumn("kind", F.lit(kind))
        results = one if results is None else results.unionByName(one)
    return results.select("kind", "n", "total")


@query(
    """SELECT count(*) AS n, CAST(count_if(held_out) AS BIGINT) AS held_out FROM (
       SELECT row_number() OVER () <= round(count(*) OVER () * 0.1::DOUBLE) AS held_out FROM conversations)"""
)
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "examples")
    rows = A.load(spark, sf_dir, "conversations").select(
        F.col("text").alias("input_text"), F.concat_ws(" ", "role", "conv_id", "turn").alias("category_dict"),
        F.col("role").alias("response"),
    )
    examples.write_examples(examples.training_examples(rows, "Classify."), folder)
    parts = [spark.read.json(f"{folder}/{n}", schema="text string").withColumn("held_out", F.lit(h)) for n, h in (("train", 0), ("validation", 1))]
    both = parts[0].unionByName(parts[1])
    return both.agg(F.count("text").alias("n"), F.sum("held_out").cast("bigint").alias("held_out"))
