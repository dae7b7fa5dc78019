"""Segments, recommendations, explanations and models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.catalog.customers import BASE_SQL, LABEL_RULE, feature_table
from retentia.catalog.registry import query, rounded, sql_round, whole
from retentia.operators import churn, explain, features, neighbors, profile, recommend, sampling, segments
from retentia.schemas import MODEL_FEATURES
from retentia.session import materialise
from retentia.sources import adapters as A

MONTH = date(2024, 1, 1)

# --- cluster profile ---------------------------------------------------------

HELD_SQL = """
WITH members AS (SELECT CAST(c_custkey AS VARCHAR) AS ccod, c_mktsegment AS cluster, c_name AS name, n_name AS biz_type
                 FROM customer JOIN nation ON n_nationkey = c_nationkey),
held AS (SELECT cluster, ccod, o_orderpriority AS target, CAST(o_orderdate AS DATE) AS day_at, CAST(o_orderkey AS VARCHAR) AS contract_no
         FROM orders JOIN members ON ccod = CAST(o_custkey AS VARCHAR)),
bought AS (SELECT cluster, ccod, p_brand AS service_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey
           JOIN part ON p_partkey = l_partkey JOIN members ON ccod = CAST(o_custkey AS VARCHAR)),
firsts AS (SELECT cluster, ccod, target FROM held QUALIFY row_number() OVER (PARTITION BY ccod ORDER BY day_at, contract_no) = 1),
sizes AS (SELECT m.cluster, m.ccod, biz_type, coalesce(h.n, 0) AS nc, coalesce(b.n, 0) AS np FROM members m
          LEFT JOIN (SELECT ccod, count(*) AS n FROM held GROUP BY 1) h USING (ccod)
          LEFT JOIN (SELECT ccod, count(*) AS n FROM bought GROUP BY 1) b USING (ccod))
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.customers(spark, sf_dir).select("ccod", "name", F.col("type_mid").alias("biz_type")).join(
        A.customer_clusters(spark, sf_dir).select("ccod", "cluster"), "ccod"
    )


def _profile_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    members = _members(spark, sf_dir)
    cluster = members.select("ccod", "cluster")
    contracts, purchases = A.contracts(spark, sf_dir), A.purchases(spark, sf_dir)
    n_contracts = contracts.groupBy("ccod").agg(F.count(F.lit(1)).alias("n_contracts"))
    n_purchases = purchases.groupBy("ccod").agg(F.count(F.lit(1)).alias("n_purchases"))
    sized = members.join(n_contracts, "ccod", "left").join(n_purchases, "ccod", "left")
    return {
        "members": sized.fillna(0, ["n_contracts", "n_purchases"]),
        "contracts": contracts.join(cluster, "ccod"),
        "purchases": purchases.join(cluster, "ccod"),
        "firsts": recommend.first_contract(contracts).join(cluster, "ccod").withColumnRenamed("first_target", "target"),
    }


def _top_list_sql(table: str, column: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster, string_agg({column}, '|' ORDER BY r) AS {name}_list FROM (
  SELECT cluster, {column}, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {column}) AS r
  FROM {table} GROUP BY cluster, {column}) WHERE r <= 5 GROUP BY cluster)"""


def _spread_sql(column: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster, string_agg(len || ':' || n, '|' ORDER BY len) AS {name}_text FROM (
  SELECT cluster, CAST({column} AS VARCHAR) AS len, count(*) AS n FROM sizes WHERE {column} > 0 GROUP BY ALL) GROUP BY cluster)"""


@query(
    f"""{HELD_SQL}, {_top_list_sql('held', 'target', 'tc')}, {_top_list_sql('bought', 'service_name', 'tp')},
{_top_list_sql('sizes', 'biz_type', 'tb')}, {_top_list_sql('firsts', 'target', 'tf')}, {_spread_sql('nc', 'dc')}, {_spread_sql('np', 'dp')},
base AS (SELECT cluster, count(DISTINCT ccod) AS cluster_size, avg(nc) AS ac, avg(np) AS ap FROM sizes GROUP BY cluster)
SELECT cluster, cluster_size, {sql_round('ac', 'avg_contracts_num')}, {sql_round('ap', 'avg_purchase_num')},
       tc_list AS top_contracts, tp_list AS top_purchases, tb_list AS top_business_type, tf_list AS top_first_contract_code,
       dc_text AS contracts_distribution, dp_text AS purchase_distribution
FROM base LEFT JOIN tc USING (cluster) LEFT JOIN tp USING (cluster) LEFT JOIN tb USING (cluster) LEFT JOIN tf USING (cluster)
     LEFT JOIN dc USING (cluster) LEFT JOIN dp USING (cluster)"""
)
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _profile_inputs(spark, sf_dir)
    rows = profile.cluster_profile(i["members"], i["contracts"], i["purchases"], i["firsts"], F.lit(MONTH))
    lists = ["top_contracts", "top_purchases", "top_business_type", "top_first_contract_code"]
    maps = ["contracts_distribution", "purchase_distribution"]
    shown = [F.array_join(c, "|").alias(c) for c in lists]
    for c in maps:
        pairs = F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"]))
        shown.append(F.array_join(pairs, "|").alias(c))
    return rows.select("cluster", *whole("cluster_size"), rounded("avg_contracts_num"), rounded("avg_purchase_num"), *shown)


@query(
    f"""{HELD_SQL} SELECT cluster, service_name AS value, count(*) AS n,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, service_name) AS rank
    FROM bought GROUP BY cluster, service_name QUALIFY rank <= 5"""
)
def cluster_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.purchases(spark, sf_dir).join(A.customer_clusters(spark, sf_dir).select("ccod", "cluster"), "ccod")
    return profile.top_values(rows, "service_name").select("cluster", "value", *whole("n", "rank"))


@query(
    f"""{HELD_SQL}, t AS (SELECT cluster, target AS value, count(*) AS n,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, target) AS rank FROM held GROUP BY cluster, target QUALIFY rank <= 5),
    s AS (SELECT cluster, count(*) AS m FROM members GROUP BY cluster)
    SELECT cluster, value, n, rank, {sql_round('n / m * 100', 'percentage')} FROM t JOIN s USING (cluster)"""
)
def cluster_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _profile_inputs(spark, sf_dir)
    top = profile.top_values_with_share(i["contracts"], i["members"], "target")
    return top.select("cluster", "value", *whole("n", "rank"), rounded("percentage"))


@query(f"{HELD_SQL} SELECT cluster, CAST(nc AS BIGINT) AS length, count(*) AS customers FROM sizes WHERE nc > 0 GROUP BY ALL")
def cluster_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _profile_inputs(spark, sf_dir)["members"]
    return profile.length_distribution(members, "n_contracts").select("cluster", *whole("length", "customers"))


# --- offers ------------------------------------------------------------------

USAGE_SQL = HELD_SQL + """
, cand AS (SELECT cluster, service_name AS item, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, service_name) AS rank
           FROM bought GROUP BY cluster, service_name QUALIFY rank <= 10),
mem AS (SELECT cluster, count(*) AS m FROM members GROUP BY cluster),
used AS (SELECT cluster, service_name AS item, count(DISTINCT ccod) AS holders FROM bought GROUP BY ALL),
rated AS (SELECT cand.cluster, cand.item, rank, holders / m * 100 AS usage_rate FROM cand JOIN used USING (cluster, item) JOIN mem USING (cluster)),
ccand AS (SELECT cluster, target AS item, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, target) AS rank
          FROM held GROUP BY cluster, target QUALIFY rank <= 10),
cused AS (SELECT cluster, target AS item, count(DISTINCT ccod) AS holders FROM held GROUP BY ALL),
crated AS (SELECT ccand.cluster, ccand.item, rank, holders / m * 100 AS usage_rate FROM ccand JOIN cused USING (cluster, item) JOIN mem USING (cluster))
"""


def _holdings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    clusters = A.customer_clusters(spark, sf_dir)
    held = clusters.select("ccod", "cluster")
    contracts = A.contracts(spark, sf_dir).select("ccod", F.col("target").alias("item")).join(held, "ccod")
    products = A.purchases(spark, sf_dir).select("ccod", F.col("service_name").alias("item")).join(held, "ccod")
    return clusters, contracts, products


@query(
    USAGE_SQL + f"""SELECT cluster, item, place, {sql_round('usage_rate', 'usage_rate')} FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY usage_rate DESC, rank) AS place FROM rated) WHERE place <= 3"""
)
def usage_rate_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _, products = _holdings(spark, sf_dir)
    rated = recommend.rated_candidates(
        recommend.candidates(products, "item"), recommend.usage_rate(products, clusters)
    )
    return recommend.best_of(rated, ["cluster"]).select("cluster", "item", *whole("place"), rounded("usage_rate"))


OFFER_SQL = USAGE_SQL + """
, choice AS (SELECT m.ccod, r.item, row_number() OVER (PARTITION BY m.ccod ORDER BY r.usage_rate DESC, r.rank) AS place, r.usage_rate
             FROM members m JOIN crated r USING (cluster) LEFT JOIN firsts f ON f.ccod = m.ccod
             WHERE f.target IS DISTINCT FROM r.item)
"""


def _offer_columns(table: str, name: str, reason: str) -> str:
    out = []
    for i in range(1, 4):
        out.append(f"coalesce(max(CASE WHEN place = {i} THEN item END), '') AS rec_{name}_{i}")
        out.append(f"coalesce(max(CASE WHEN place = {i} THEN printf('{reason}', usage_rate) END), '') AS rec_{name}_{i}_reason")
    return ", ".join(out)


CONTRACT_OFFERS = _offer_columns("choice", "contract", recommend.CONTRACT_REASON)


@query(OFFER_SQL + f"SELECT ccod, {CONTRACT_OFFERS} FROM choice GROUP BY ccod")
def first_contract_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, contracts, _ = _holdings(spark, sf_dir)
    firsts = recommend.first_contract(A.contracts(spark, sf_dir))
    rated = recommend.rated_candidates(
        recommend.candidates(contracts, "item"), recommend.usage_rate(contracts, clusters)
    )
    offered = recommend.offers(clusters.join(firsts, "ccod", "left"), rated, "first_target")
    return offered.select("ccod", *recommend.wide_offers("contract", recommend.CONTRACT_REASON, F.col("offers")))


# --- nearest peer and similarity ---------------------------------------------

PAIRS_SQL = """
WITH e AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id, b.id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.cluster = b.cluster AND a.id <> b.id),
nearest AS (SELECT id, neighbor_id, d FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) = 1)
"""


@query(PAIRS_SQL + f"SELECT id, neighbor_id, {sql_round('d', 'distance')} FROM nearest")
def nearest_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = A.cluster_members(spark, sf_dir)
    found = neighbors.nearest_in_cluster(members, members, exclude_self=True)
    return found.select("id", "neighbor_id", rounded("distance"))


CENTER_SQL = """
WITH e AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT id, cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM e),
c AS (SELECT cluster, list(m ORDER BY dim) AS center FROM (SELECT cluster, dim, avg(x) AS m FROM x GROUP BY ALL) GROUP BY cluster),
d AS (SELECT e.id, e.cluster, c.cluster AS other, list_distance(v, center) AS d FROM e, c),
own AS (SELECT id, cluster, d, 1 - d / (SELECT max(d) FROM d) AS s FROM d WHERE cluster = other)
"""


@query(CENTER_SQL + f"SELECT id, CAST(cluster AS BIGINT) AS cluster, {sql_round('d', 'distance')}, {sql_round('s', 'similarity')} FROM own")
def cluster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = A.cluster_members(spark, sf_dir)
    scored = segments.cluster_similarity(members, segments.centroids(members))
    return scored.select("id", *whole("cluster"), rounded("distance"), rounded("similarity"))


PAYLOAD_SQL = (
    OFFER_SQL + f""", cchoice AS (SELECT ccod, {CONTRACT_OFFERS} FROM choice GROUP BY ccod),
pplace AS (SELECT m.ccod, r.item, row_number() OVER (PARTITION BY m.ccod ORDER BY r.usage_rate DESC, r.rank) AS place, r.usage_rate
           FROM members m JOIN rated r USING (cluster)),
pchoice AS (SELECT ccod, {_offer_columns('pplace', 'product', recommend.PRODUCT_REASON)} FROM pplace GROUP BY ccod),
pt AS (SELECT CAST(c_custkey AS VARCHAR) AS ccod, c_custkey AS id, c_mktsegment AS cluster, c_acctbal AS x, c_nationkey AS y FROM customer),
pr AS (SELECT a.ccod, b.ccod AS sim_ccod, row_number() OVER (
         PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r
       FROM pt a JOIN pt b ON a.cluster = b.cluster AND a.id <> b.id),
sim AS (SELECT ccod, sim_ccod FROM pr WHERE r = 1),
clists AS (SELECT ccod, '["' || string_agg(DISTINCT target, '","' ORDER BY target) || '"]' AS l FROM held GROUP BY ccod),
plists AS (SELECT ccod, '["' || string_agg(DISTINCT service_name, '","' ORDER BY service_name) || '"]' AS l FROM bought GROUP BY ccod)
SELECT m.ccod, '2024-01-01' AS snapshot_month, m.cluster AS user_cluster, coalesce(sim_ccod, '') AS sim_ccod,
       coalesce(o.name, '') AS sim_user_name, coalesce(clists.l, '[]') AS sim_user_contracts, coalesce(plists.l, '[]') AS sim_user_products,
       cchoice.* EXCLUDE (ccod), pchoice.* EXCLUDE (ccod)
FROM members m JOIN cchoice ON cchoice.ccod = m.ccod JOIN pchoice ON pchoice.ccod = m.ccod
     LEFT JOIN sim ON sim.ccod = m.ccod LEFT JOIN members o ON o.ccod = sim_ccod
     LEFT JOIN clists ON clists.ccod = sim_ccod LEFT JOIN plists ON plists.ccod = sim_ccod"""
)


@query(PAYLOAD_SQL)
def recommendation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, contracts, products = _holdings(spark, sf_dir)
    points = A.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cluster"),
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("vec"),
    )
    near = neighbors.nearest_in_cluster(points, points, exclude_self=True).select(
        F.col("id").cast("string").alias("ccod"), F.col("neighbor_id").cast("string").alias("sim_ccod")
    )
    firsts = recommend.first_contract(A.contracts(spark, sf_dir))
    customers = clusters.select("ccod", "cluster", F.lit(1.0).alias("similarity")).join(firsts, "ccod", "left")
    rows = recommend.recommendations(
        customers, near, clusters, contracts.select("ccod", "item"), products.select("ccod", "item"), F.lit(MONTH)
    )
    return rows.drop("cluster_similarity").withColumn("snapshot_month", F.date_format("snapshot_month", "yyyy-MM-dd"))


# --- explanations ------------------------------------------------------------

# A stand-in for a fitted model's importances, so that SQL can follow.
IMPORTANCE = [((7 * i + 3) % 11 + 1) / 100 for i in range(len(MODEL_FEATURES))]


def _explain_sql(boosted: bool) -> str:
    values = []
    for f in MODEL_FEATURES:
        if f == "confirmed_90d" and boosted:
            values.append(
                "0.1::DOUBLE * ln(1 + least(confirmed_90d, (SELECT avg(confirmed_90d) + 0.5 * stddev_samp(confirmed_90d) FROM features)))"
                " AS confirmed_90d"
            )
        else:
            values.append(f"CAST({f} AS DOUBLE) * {explain.BOOSTS.get(f, 1.0) if boosted else 1.0}::DOUBLE AS {f}")
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in MODEL_FEATURES)
    items = ", ".join(
        f"{{'i': {i}, 'feature': '{f}', 'value': {f}, 'c': round(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0 END"
        f" * {IMPORTANCE[i] * explain.diversity_weight(f)!r}::DOUBLE, 9) + 0.0::DOUBLE}}"
        for i, f in enumerate(MODEL_FEATURES)
    )
    return f"""{BASE_SQL}, scored AS (SELECT ccod, {', '.join(values)} FROM features),
stats AS (SELECT {stats} FROM scored),
items AS (SELECT ccod, unnest([{items}]) AS x FROM scored, stats),
top AS (SELECT ccod, x.feature AS feature, x.value AS value, x.c AS contribution,
        row_number() OVER (PARTITION BY ccod ORDER BY abs(x.c) DESC, x.i) AS place FROM items QUALIFY place <= 10)
"""


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Statistics and explanations read the stored features, not the history.
    values = explain.scoring_variant(materialise(feature_table(spark, sf_dir), "features"))
    return explain.top_contributions(values, IMPORTANCE, places=9)


@query(_explain_sql(True) + f"SELECT ccod, feature, place, {sql_round('value', 'value')}, {sql_round('contribution', 'contribution')} FROM top")
def zscore_explain_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _explained(spark, sf_dir).select("ccod", F.posexplode("top").alias("i", "t"))
    return rows.select(
        "ccod", "t.feature", (F.col("i") + 1).cast("bigint").alias("place"),
        rounded("t.value", name="value"), rounded("t.contribution", name="contribution"),
    )


# Stand-ins for the class means of a training set.
NORMAL = {f: (i % 7) / 8 for i, f in enumerate(MODEL_FEATURES) if i % 5}
CHURNED = {f: (i % 9) / 16 for i, f in enumerate(MODEL_FEATURES) if i % 4}


def _wide_sql() -> str:
    def case(column: str, table: dict, default: str) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
        return f"CASE {column} {whens} ELSE {default} END"

    parts = []
    for n in range(1, 11):
        def pick(expr: str, n: int = n) -> str:
            return f"max(CASE WHEN place = {n} THEN {expr} END)"

        parts += [
            f"{pick(case('feature', explain.DISPLAY_NAMES, 'feature'))} AS feature_{n}_kor",
            sql_round(pick("value"), f"feature_{n}_value", 3),
            f"round_even(CAST({pick(case('feature', NORMAL, '0.0'))} AS DOUBLE), 4) + 0.0::DOUBLE AS feature_{n}_normal_average",
            f"round_even(CAST({pick(case('feature', CHURNED, '0.0'))} AS DOUBLE), 4) + 0.0::DOUBLE AS feature_{n}_churn_average",
            sql_round(pick("contribution"), f"feature_{n}_contrib", 3),
            f"{pick(case_label())} AS feature_{n}_contrib_label",
        ]
    return _explain_sql(True) + f"SELECT ccod, {', '.join(parts)} FROM top GROUP BY ccod"


def case_label() -> str:
    return "CASE WHEN abs(contribution) >= 0.3 THEN '높음' WHEN abs(contribution) >= 0.2 THEN '보통' ELSE '낮음' END"


@query(_wide_sql())
def explain_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = _explained(spark, sf_dir)
    columns = explain.wide_explanation(explained, NORMAL, CHURNED)
    shown = []
    for n in range(explain.TOP):
        label, _, normal, churned, _, impact = columns[6 * n : 6 * n + 6]
        t = F.get("top", F.lit(n))
        # Values at three decimals: the two engines sum in different orders.
        shown += [
            label, rounded(t["value"], 3, f"feature_{n + 1}_value"), normal, churned,
            rounded(t["contribution"], 3, f"feature_{n + 1}_contrib"), impact,
        ]
    return explained.select("ccod", *shown)


MEAN_FEATURES = ["work_last_30d", "cancellation_rate", "avg_csi_score", "voc_ratio", "activity_density"]


@query(
    f"""{BASE_SQL} SELECT CAST(work_last_30d <= 2 AND work_last_60d <= 3 AND work_last_90d <= 5 AS BIGINT) AS churn,
    {', '.join(sql_round(f'avg({f})', f) for f in MEAN_FEATURES)} FROM features GROUP BY 1"""
)
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_table(spark, sf_dir).withColumn("churn", features.churn_label(LABEL_RULE))
    return explain.class_means(rows, "churn", MEAN_FEATURES).select(*whole("churn"), *[rounded(f) for f in MEAN_FEATURES])


@query(
    f"""{BASE_SQL}, u AS (UNPIVOT (SELECT {', '.join(f'avg(abs({f})) AS {f}' for f in MODEL_FEATURES)} FROM features)
    ON {', '.join(MODEL_FEATURES)} INTO NAME feature VALUE importance)
    SELECT feature, {sql_round('importance', 'importance')} FROM u ORDER BY round(importance, 6) DESC, feature LIMIT 10"""
)
def importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = feature_table(spark, sf_dir).agg(*[F.avg(F.abs(f)).alias(f) for f in MODEL_FEATURES])
    long = means.unpivot([], MODEL_FEATURES, "feature", "importance")
    return long.select("feature", rounded("importance")).orderBy(F.desc("importance"), "feature").limit(10)


# --- segments ----------------------------------------------------------------

SEGMENT_SQL = """
WITH base AS (
  SELECT CAST(c_custkey AS VARCHAR) AS ccod, c_custkey, r_name AS class_major, n_name AS class_mid, c_mktsegment AS class_minor,
         CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE c_name END AS class_detail, c_nationkey, c_acctbal
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.segment_customers(spark, sf_dir)
    codes = materialise(segments.label_codes(rows, segments.LABEL_COLUMNS), "codes")
    encoded = segments.encode_labels(rows, codes, segments.LABEL_COLUMNS)
    return materialise(segments.with_defaults(encoded), "encoded")


@query(
    SEGMENT_SQL + """
, a AS (SELECT class_mid AS l, row_number() OVER (ORDER BY class_mid) - 1 AS code FROM (SELECT DISTINCT class_mid FROM base)),
b AS (SELECT class_detail AS l, row_number() OVER (ORDER BY class_detail) - 1 AS code FROM (SELECT DISTINCT class_detail FROM base))
SELECT ccod, CAST(a.code AS BIGINT) AS class_mid_code, CAST(b.code AS BIGINT) AS class_detail_code
FROM base JOIN a ON a.l = class_mid JOIN b ON b.l = class_detail"""
)
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.segment_customers(spark, sf_dir)
    columns = ["class_mid", "class_detail"]
    rows = segments.encode_labels(rows, segments.label_codes(rows, columns), columns)
    return rows.select("ccod", *whole("class_mid_code", "class_detail_code"))


@query(
    SEGMENT_SQL + f"""
, f AS (SELECT ccod, coalesce(CASE WHEN c_nationkey <> 3 THEN 33 + c_nationkey / 5 END, 37.5) AS lat, 126 + c_nationkey % 4 AS lon,
        CASE WHEN coalesce(a, 50) <= 22 THEN 0 WHEN coalesce(a, 50) <= 50 THEN 1 WHEN a <= 258 THEN 2 WHEN a <= 1600 THEN 3
             WHEN a <= 4950 THEN 4 ELSE 5 END AS area_bucket
        FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a FROM base))
SELECT ccod, {', '.join(sql_round(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in ("lat", "lon", "area_bucket"))} FROM f"""
)
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["lat", "lon", "area_bucket"]
    rows = segments.standardise(segments.with_defaults(A.segment_customers(spark, sf_dir)), columns)
    return rows.select("ccod", *[rounded(c) for c in columns])


def _segment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _encoded(spark, sf_dir)
    projected = segments.apply_class_pca(encoded, *segments.fit_class_pca(encoded))
    scaled = segments.standardise(projected, segments.FEATURES)
    return materialise(segments.with_vector(scaled, segments.FEATURES).select("ccod", "features"), "vectors")


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = _encoded(spark, sf_dir)
    projected = segments.apply_class_pca(encoded, *segments.fit_class_pca(encoded))
    return projected.select("ccod", rounded("class_pca1", 4), rounded("class_pca2", 4))


@query()
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segment_vectors(spark, sf_dir)
    model = segments.fit_clusters(rows)
    longest = segments.longest_center_distance(rows, model)
    own = segments.center_distance(F.col("features"), F.col("cluster"), model)
    return model.transform(rows).select("ccod", "cluster", rounded(1 - own / longest, name="similarity"))


@query()
def cluster_count_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segment_vectors(spark, sf_dir)
    _, scores = segments.choose_k(rows)
    values = [(s.k, s.cost, s.silhouette, s.davies_bouldin) for s in scores]
    return spark.createDataFrame(values, "k int, cost double, silhouette double, davies_bouldin double")


# --- model -------------------------------------------------------------------

def _training(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and rows held out, of a written feature table."""
    rows = features.training_rows(table, min_work=1, rule=LABEL_RULE)
    split = materialise(sampling.stratified_split(rows, "ccod", "churn", 0.2), "split")
    return split.where("held_out = 0"), split.where("held_out = 1")


@query()
def churn_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Training and scoring read the same stored features.
    rows = materialise(feature_table(spark, sf_dir), "features")
    fit_on, _ = _training(rows)
    model = churn.fit_churn(fit_on)
    means = explain.mean_maps(explain.class_means(fit_on, "churn", MODEL_FEATURES), "churn", MODEL_FEATURES)
    predictions = churn.predict_churn(model, rows, F.lit(MONTH), means[0], means[1])
    return predictions.withColumn("churn_prob", F.round("churn_prob", 6))


@query()
def churn_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit_on, held_out = _training(materialise(feature_table(spark, sf_dir), "features"))
    scored = materialise(churn.score(churn.fit_churn(fit_on), held_out), "scores")
    auc = churn.roc_auc(scored, "churn", "churn_prob").select("roc_auc").scalar()
    return churn.class_report(scored, "churn", "churn_label").withColumn("roc_auc", auc)


@query(
    f"""WITH s AS (SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
    c AS (SELECT score, count_if(label = 1) AS ones, count_if(label <> 1) AS zeros FROM s GROUP BY score),
    r AS (SELECT ones, zeros, coalesce(sum(zeros) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT CAST(sum(ones) AS BIGINT) AS positives, CAST(sum(zeros) AS BIGINT) AS negatives,
           {sql_round('sum(ones * (below + zeros / 2)) / (sum(ones) * sum(zeros))', 'roc_auc', 9)} FROM r"""
)
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the length of a text tells its quality: the area under the curve by ranks."""
    lengths = A.load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = A.load(spark, sf_dir, "labels").select("doc_id", "quality").join(lengths, "doc_id")
    found = churn.roc_auc(rows, "quality", "n_chars")
    return found.select(*whole("positives", "negatives"), rounded("roc_auc", 9))


@query(
    """WITH l AS (SELECT quality AS class, toxic AS said FROM labels),
    s AS (SELECT class, count(*) AS support, count_if(class = said) AS hits FROM l GROUP BY class),
    p AS (SELECT said AS class, count(*) AS predicted FROM l GROUP BY said),
    b AS (SELECT coalesce(s.class, p.class) AS class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
          coalesce(hits, 0) / nullif(predicted, 0) AS p, coalesce(hits, 0) / nullif(support, 0) AS r FROM s FULL JOIN p ON s.class = p.class)
    SELECT CAST(class AS BIGINT) AS class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, """
    + ", ".join([sql_round("coalesce(p, 0)", "precision"), sql_round("coalesce(r, 0)", "recall"),
                 sql_round("coalesce(2 * p * r / nullif(p + r, 0), 0)", "f1")]) + " FROM b"
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = churn.class_report(A.load(spark, sf_dir, "labels"), "quality", "toxic")
    return report.select(*whole("class", "support", "predicted"), *[rounded(c) for c in ("precision", "recall", "f1")])


@query("SELECT CAST(quality AS BIGINT) AS label, CAST(toxic AS BIGINT) AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return churn.confusion(rows, "label", "prediction").select(*whole("label", "prediction", "n"))
