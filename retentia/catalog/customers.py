"""Active customers and churn features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.catalog.registry import day_text, query, rounded, sql_day, sql_int, sql_round, whole
from retentia.operators import contracts as C
from retentia.operators import features as X
from retentia.operators import history, keys, quality, sampling
from retentia.operators.selection import concurrently
from retentia.schemas import (
    COUNT_FEATURES,
    CSI_FEATURES,
    GRANULAR_FEATURES,
    MODEL_FEATURES,
    VOC_FEATURES,
    WINDOWS,
    WORK_FEATURES,
)
from retentia.session import materialise, scratch_dir
from retentia.sources import adapters as A

AS_OF, CUTOFF = date(2001, 1, 1), date(1998, 1, 1)

# --- contracts ---------------------------------------------------------------

CONTRACTS_SQL = """
WITH contracts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ccod, CAST(o_orderkey AS VARCHAR) AS contract_no,
         o_orderpriority AS target, CAST(o_orderdate AS DATE) AS start_at,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + 365 END AS end_at,
         (o_orderstatus = 'P' AND o_orderkey % 7 = 0) AS open_ended,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 365 AS INTEGER) END AS cancel_at,
         CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'P' THEN 'FALSE' ELSE 'TRUE' END AS cancelled
  FROM orders),
nexts AS (
  SELECT *, lead(start_at) OVER (PARTITION BY ccod, target
                                 ORDER BY start_at NULLS LAST, contract_no) AS next_start_at
  FROM contracts),
finals AS (
  SELECT *, coalesce(cancel_at,
                     CASE WHEN end_at >= DATE '1998-01-01' THEN coalesce(next_start_at, start_at) END,
                     CASE WHEN end_at < DATE '2001-01-01' THEN end_at END) AS final_cancel_at
  FROM nexts),
resolved AS (
  SELECT *, coalesce(final_cancel_at, CASE WHEN end_at > DATE '2001-01-01' THEN DATE '2001-01-01' END) AS logical_end_at,
         final_cancel_at IS NULL AS c1, cancelled IN ('FALSE', 'F', 'N', '0') AS c2,
         coalesce(end_at > DATE '2001-01-01', FALSE) AS c3
  FROM finals),
tenures AS (SELECT *, date_diff('day', start_at, logical_end_at) AS tenure_days FROM resolved)
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_contracts(A.contracts(spark, sf_dir), AS_OF, CUTOFF)


@query(CONTRACTS_SQL + f"SELECT ccod, contract_no, target, {sql_day('start_at')}, {sql_day('next_start_at')} FROM nexts")
def next_contract_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select(
        "ccod", "contract_no", "target", day_text("start_at"), day_text("next_start_at")
    )


RESOLVED_DAYS = ["end_at", "final_cancel_at", "logical_end_at"]


@query(
    CONTRACTS_SQL
    + f"SELECT ccod, contract_no, {', '.join(sql_day(c) for c in RESOLVED_DAYS)}, CAST(open_ended AS INTEGER) AS open_ended, "
    + "CAST(coalesce(tenure_days, -1) AS BIGINT) AS tenure_days FROM tenures"
)
def resolved_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select(
        "ccod", "contract_no", *[day_text(c) for c in RESOLVED_DAYS], F.col("open_ended").cast("int").alias("open_ended"),
        F.coalesce("tenure_days", F.lit(-1)).cast("bigint").alias("tenure_days"),
    )


def _status_sql(condition: str) -> str:
    return CONTRACTS_SQL + f"""
, activity AS (
  SELECT ccod, bool_or({condition}) AS active, count(DISTINCT target) AS t, count(contract_no) AS n
  FROM resolved GROUP BY ccod)
SELECT CAST(c_custkey AS VARCHAR) AS ccod, CAST(coalesce(active, FALSE) AS BIGINT) AS status,
       CAST(coalesce(t, 0) AS BIGINT) AS unique_targets, CAST(coalesce(n, -1) AS BIGINT) AS total_contracts
FROM customer LEFT JOIN activity ON ccod = CAST(c_custkey AS VARCHAR)
"""


def _status(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    activity = C.customer_activity(_resolved(spark, sf_dir), AS_OF, rule)
    base = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ccod"))
    return C.customers_with_status(base, activity).select(
        "ccod", *whole("status", "unique_targets"),
        F.coalesce("total_contracts", F.lit(-1)).cast("bigint").alias("total_contracts"),
    )


@query(_status_sql("c1 OR c2 OR c3"))
def active_customers_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir, "any")


@query(_status_sql("c1 AND c2 AND (c3 OR open_ended)"))
def active_customers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir, "all")


SUMMARY_SQL = """
, summary AS (
  SELECT ccod, target, count(contract_no) AS contract_count, count(DISTINCT contract_no) AS distinct_contracts,
         min(start_at) AS first_start_at, max(end_at) AS last_end_at, count(final_cancel_at) AS cancel_count,
         min(final_cancel_at) AS first_cancel_at, max(final_cancel_at) AS last_cancel_at,
         max(logical_end_at) AS last_logical_end_at, min(logical_end_at) AS first_logical_end_at,
         CAST(coalesce(sum(tenure_days), 0) AS BIGINT) AS tenure_days
  FROM tenures WHERE target IS NOT NULL GROUP BY ccod, target),
flagged AS (
  SELECT *, CAST(contract_count <= cancel_count AS BIGINT) AS fully_cancelled FROM summary)
"""
SUMMARY_DAYS = [
    "first_start_at", "last_end_at", "first_cancel_at", "last_cancel_at", "last_logical_end_at", "first_logical_end_at",
]
SUMMARY_COUNTS = ["contract_count", "distinct_contracts", "cancel_count", "tenure_days", "fully_cancelled"]


@query(
    CONTRACTS_SQL + SUMMARY_SQL
    + f"SELECT ccod, target, {', '.join(SUMMARY_COUNTS)}, {', '.join(sql_day(c) for c in SUMMARY_DAYS)} FROM flagged"
)
def contract_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = C.target_summary(_resolved(spark, sf_dir))
    return summary.select("ccod", "target", *whole(*SUMMARY_COUNTS), *[day_text(c) for c in SUMMARY_DAYS])


@query(
    CONTRACTS_SQL + SUMMARY_SQL + """
SELECT ccod, count(target) AS targets, CAST(sum(fully_cancelled) AS BIGINT) AS cancelled_targets,
       CAST(count(target) > sum(fully_cancelled) AS BIGINT) AS status
FROM flagged GROUP BY ccod"""
)
def customer_status_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = C.status_by_target(C.target_summary(_resolved(spark, sf_dir)))
    return status.select("ccod", *whole("targets", "cancelled_targets", "status"))


@query(
    CONTRACTS_SQL + """
SELECT count(*) AS contracts, CAST(count_if(cancel_at IS NULL) AS BIGINT) AS no_cancel_date, CAST(count_if(c1) AS BIGINT) AS no_final_cancel,
       CAST(count_if(c2) AS BIGINT) AS flag_false, CAST(count_if(c3) AS BIGINT) AS ends_later, CAST(count_if(c1 AND c2) AS BIGINT) AS no_final_and_flag,
       CAST(count_if(c1 AND c3) AS BIGINT) AS no_final_and_later, CAST(count_if(c2 AND c3) AS BIGINT) AS flag_and_later FROM resolved"""
)
def qa_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = quality.contract_counters(_resolved(spark, sf_dir), AS_OF)
    return counters.select(*whole(*counters.columns))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def qa_value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    return quality.value_distribution(rows, "status")


# --- features ----------------------------------------------------------------

WORKS_SQL = """
WITH works AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ccod, l_shipdate AS work_at, CAST(l_linenumber AS VARCHAR) AS work_type,
         l_linestatus = 'F' AS confirmed, l_returnflag = 'R' AS cancelled, CAST(l_quantity AS BIGINT) AS n_services,
         CASE WHEN l_returnflag <> 'N' THEN round(l_discount * 100) END AS csi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
aged AS (
  SELECT *, (epoch_us(max(work_at) OVER (PARTITION BY ccod)) - epoch_us(work_at)) // 86400000000 AS age FROM works)
"""


def _work_sql() -> str:
    parts = [
        "ccod", "count(*) AS work_count", "count(DISTINCT work_type) AS unique_work_types",
        "count_if(confirmed) AS confirmed_work", "count_if(cancelled) AS cancelled_work",
        "(epoch_us(max(work_at)) - epoch_us(min(work_at))) // 86400000000 AS work_span_days",
        "count_if(cancelled) / count(*) AS cancellation_rate", "count_if(confirmed) / count(*) AS confirmation_rate",
        "sum(n_services) / count(*) AS avg_services_per_work",
        "coalesce(avg(csi), 0) AS avg_csi_score", "count(csi) AS csi_survey_count",
    ]
    for d in WINDOWS:
        f = f"FILTER (WHERE age <= {d})"
        parts += [
            f"count(*) {f} AS work_last_{d}d",
            f"count_if(confirmed) {f} AS confirmed_{d}d",
            f"count_if(cancelled) {f} AS cancelled_{d}d",
            f"coalesce(sum(n_services) {f}, 0) AS services_{d}d",
            f"count(DISTINCT work_type) {f} AS work_types_{d}d",
            f"coalesce(count_if(cancelled) {f} / nullif(count(*) {f}, 0), 0) AS cancellation_rate_{d}d",
            f"coalesce(count_if(confirmed) {f} / nullif(count(*) {f}, 0), 0) AS confirmation_rate_{d}d",
            f"coalesce(avg(csi) {f}, 0) AS csi_score_{d}d",
            f"count(csi) {f} AS csi_survey_count_{d}d",
        ]
    return f"SELECT {', '.join(parts)} FROM aged GROUP BY ccod"


VOC_AGED_SQL = """
voc_aged AS (
  SELECT CAST(o_custkey AS VARCHAR) AS ccod, o_orderpriority = '1-URGENT' AS voc,
         (epoch_us(max(o_orderdate) OVER (PARTITION BY o_custkey)) - epoch_us(o_orderdate)) // 86400000000 AS age
  FROM orders)
"""


def _voc_sql() -> str:
    parts = [
        "ccod", "count(*) AS num_interactions", "count_if(voc) AS voc_count", "count_if(NOT voc) AS non_voc_count",
        "count_if(voc) / count(*) AS voc_ratio",
    ]
    for d in WINDOWS:
        f = f"FILTER (WHERE age <= {d})"
        parts += [
            f"count(*) {f} AS interactions_{d}d", f"count_if(voc) {f} AS voc_{d}d", f"count_if(NOT voc) {f} AS non_voc_{d}d",
            f"coalesce(count_if(voc) {f} / nullif(count(*) {f}, 0), 0) AS voc_ratio_{d}d",
        ]
    return f"SELECT {', '.join(parts)} FROM voc_aged GROUP BY ccod"


INTEGER_FEATURES = set(COUNT_FEATURES) | {"work_count", "confirmed_work", "work_span_days"}


def sql_features(names: list[str]) -> str:
    return ", ".join(sql_int(f, f) if f in INTEGER_FEATURES else sql_round(f, f) for f in names)


def spark_features(names: list[str]) -> list:
    return [whole(f)[0] if f in INTEGER_FEATURES else rounded(f) for f in names]


BASE_SQL = f"""{WORKS_SQL}, {VOC_AGED_SQL}, work_f AS ({_work_sql()}), voc_f AS ({_voc_sql()}),
joined AS (
  SELECT CAST(c_custkey AS VARCHAR) AS ccod, {', '.join(f'coalesce({f}, 0) AS {f}' for f in WORK_FEATURES + CSI_FEATURES + VOC_FEATURES)}
  FROM customer LEFT JOIN work_f ON work_f.ccod = CAST(c_custkey AS VARCHAR)
  LEFT JOIN voc_f ON voc_f.ccod = CAST(c_custkey AS VARCHAR)),
features AS (
  SELECT *, work_last_90d / (work_count + 1e-8) AS recent_90d_activity_ratio,
         work_last_30d / (work_count + 1e-8) AS recent_30d_activity_ratio,
         work_count / (work_span_days + 1) AS activity_density,
         confirmation_rate_30d - confirmation_rate AS confirmation_rate_change,
         cancellation_rate_30d - cancellation_rate AS cancellation_rate_change,
         voc_count / (work_count + 1e-8) AS voc_to_work_ratio,
         work_last_30d / (work_last_90d + 1e-8) AS recent_30d_to_90d_ratio
  FROM joined)
"""


def work_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.work_features(A.work_orders(spark, sf_dir))


def feature_table(spark: SparkSession, sf_dir: str, helpers: bool = False) -> DataFrame:
    base = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ccod"))
    return X.customer_features(
        base, work_table(spark, sf_dir), X.voc_features(A.interactions(spark, sf_dir)), helpers=helpers
    )


@query(f"{WORKS_SQL}, f AS ({_work_sql()}) SELECT ccod, {sql_features(WORK_FEATURES)} FROM f")
def work_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(spark, sf_dir).select("ccod", *spark_features(WORK_FEATURES))


@query(f"{WORKS_SQL}, f AS ({_work_sql()}) SELECT ccod, {sql_features(CSI_FEATURES)} FROM f")
def csi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(spark, sf_dir).select("ccod", *spark_features(CSI_FEATURES))


@query(f"WITH {VOC_AGED_SQL}, f AS ({_voc_sql()}) SELECT ccod, {sql_features(VOC_FEATURES)} FROM f")
def voc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.voc_features(A.interactions(spark, sf_dir)).select("ccod", *spark_features(VOC_FEATURES))


@query(f"{BASE_SQL} SELECT ccod, {sql_features(GRANULAR_FEATURES)} FROM features")
def granular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir).select("ccod", *spark_features(GRANULAR_FEATURES))


@query(f"{BASE_SQL} SELECT ccod, {sql_features(MODEL_FEATURES)} FROM features")
def monthly_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.monthly_property(feature_table(spark, sf_dir)).select("ccod", *spark_features(MODEL_FEATURES))


# Ends of the parts in which the history below arrives; the rows of every ninth day come a part late.
PARTS = [date(1994, 1, 1), date(1997, 6, 1), date(2100, 1, 1)]


def incremental_features(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The feature table from stored states, each made of the one before and the rows that are new."""
    months = [date(2024, n, 1) for n in range(1, len(PARTS) + 1)]
    due = F.lit(len(PARTS) - 1)
    for n in reversed(range(len(PARTS))):
        due = F.when(F.col("at") < F.lit(PARTS[n]), n).otherwise(due)
    late = F.least(due + (F.dayofmonth("at") % 9 == 0).cast("int"), F.lit(len(PARTS) - 1))

    def arrive(name: str, moments: DataFrame, measures: history.Measures) -> None:
        # A moment arrives whole, so the sources are read once; each month then reads its part.
        arrived = materialise(moments.withColumn("_part", F.coalesce(late, F.lit(0))), f"{name}-arrived", by="_part")
        for n, month in enumerate(months):
            new = arrived.where(F.col("_part") == n).drop("_part")
            history.advance_month(spark, f"{path}/{name}", months[n - 1] if n else None, month, new, measures, written=True)

    work_moments, voc_moments = X.work_moments(A.work_orders(spark, sf_dir)), X.interaction_moments(A.interactions(spark, sf_dir))
    concurrently(spark, [lambda: arrive("work", work_moments, X.WORK), lambda: arrive("voc", voc_moments, X.INTERACTIONS)])
    work, voc = (history.State.load(spark, f"{path}/{name}", months[-1]) for name in ("work", "voc"))
    base = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ccod"))
    return X.customer_features(
        base, X.work_features_of(work.by_kind(X.WORK)), X.voc_features_of(voc.by_kind(X.INTERACTIONS))
    )


@query(f"{BASE_SQL} SELECT ccod, {sql_features(MODEL_FEATURES)} FROM features")
def monthly_property_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored features when the history arrives in three parts, some rows late, and each run reads only its part."""
    rows = incremental_features(spark, sf_dir, scratch_dir(spark, "history"))
    return X.monthly_property(rows).select("ccod", *spark_features(MODEL_FEATURES))


HEADER_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS work_no, CAST(o_custkey AS VARCHAR) AS ccod, count(l_orderkey) AS n_services,
       CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' AND CAST(l_quantity AS INTEGER) % 10 <> 0 THEN l_quantity END), 0)
            AS BIGINT) AS csi_sum,
       CAST(count_if(coalesce(l_returnflag = 'R' AND CAST(l_quantity AS INTEGER) % 10 <> 0, FALSE)) AS BIGINT) AS csi_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey
"""


@query(HEADER_SQL)
def work_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = X.attach_children(A.work_headers(spark, sf_dir), A.work_services(spark, sf_dir), A.work_surveys(spark, sf_dir))
    return works.select("work_no", "ccod", *whole("n_services", "csi_sum", "csi_count"))


LABEL_RULE = {"work_last_30d": 2, "work_last_60d": 3, "work_last_90d": 5}


@query(
    f"""{BASE_SQL} SELECT ccod, CAST(work_last_90d AS BIGINT) AS work_last_90d,
    CAST(work_last_30d <= 2 AND work_last_60d <= 3 AND work_last_90d <= 5 AS BIGINT) AS churn
    FROM features WHERE work_last_90d >= 2"""
)
def churn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.training_rows(feature_table(spark, sf_dir), min_work=2, rule=LABEL_RULE)
    return rows.select("ccod", *whole("work_last_90d", "churn"))


@query(
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ccod, o_orderpriority AS target FROM orders "
    "ORDER BY ccod, target LIMIT 10000"
)
def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.contracts(spark, sf_dir).select("ccod", "target").distinct()
    return rows.orderBy("ccod", "target").limit(10_000)


# --- keys --------------------------------------------------------------------


@query(
    """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ccod FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
      AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')"""
)
def incremental_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ccod"), "o_orderdate")
    wanted = A.load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("ccod"))
    done = o.where(F.col("o_orderdate") >= F.lit(date(2001, 6, 1)))
    return keys.unprocessed(keys.restrict_to(keys.distinct_keys(o), wanted), keys.distinct_keys(done))


KEY_SIDES_SQL = """
WITH l AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1),
     r AS (SELECT c_custkey AS k, count(*) AS r FROM customer WHERE c_acctbal > 0 GROUP BY 1),
     b AS (SELECT l, r FROM l FULL JOIN r ON l.k = r.k)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = A.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ccod"))
    right = A.load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ccod"))
    return left, right


@query(
    KEY_SIDES_SQL + """SELECT CAST(coalesce(sum(l), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_rows,
    CAST(count_if(r IS NULL) AS BIGINT) AS only_left, CAST(count_if(l IS NULL) AS BIGINT) AS only_right FROM b"""
)
def output_key_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keys.key_difference(*_sides(spark, sf_dir))
    return d.select(*whole(*d.columns))


@query(
    KEY_SIDES_SQL + """SELECT CAST(coalesce(sum(l * r), 0) AS BIGINT) AS joined_rows, count(*) AS joined_keys
    FROM b WHERE l IS NOT NULL AND r IS NOT NULL"""
)
def coverage_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keys.coverage(*_sides(spark, sf_dir))
    return d.select(*whole(*d.columns))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS ccod, 'customer only' AS side FROM customer
    WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)
    UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'order only' FROM orders
    WHERE o_totalprice > 250000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("ccod"))
    big = A.load(spark, sf_dir, "orders").where("o_totalprice > 250000")
    o = keys.distinct_keys(big.select(F.col("o_custkey").cast("string").alias("ccod")))
    only_c = keys.unprocessed(c, o).withColumn("side", F.lit("customer only"))
    return only_c.unionByName(keys.unprocessed(o, c).withColumn("side", F.lit("order only")))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS bzno, s_name AS enp_nm FROM supplier
    WHERE s_acctbal >= 0 AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""
)
def prospect_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    prospects = A.load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("bzno"), F.col("s_name").alias("enp_nm"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("area"),
    )
    known = A.load(spark, sf_dir, "customer").where("c_acctbal < 5000").select(
        F.col("c_custkey").cast("string").alias("biz_no")
    )
    return keys.eligible_prospects(prospects, known, ["bzno", "enp_nm", "area"]).select("bzno", "enp_nm")


SPLIT_SQL = """
WITH hashed AS (
  SELECT doc_id, quality, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 15) AS BIGINT) AS h FROM labels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM hashed)
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(r <= round(n * 0.2::DOUBLE) AS BIGINT) AS held_out FROM ranked
"""


@query(SPLIT_SQL)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.stratified_split(A.load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2)
    return rows.select("doc_id", *whole("quality", "held_out"))
