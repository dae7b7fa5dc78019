"""The recommendation runs: a published segment model scores customers and prospects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.catalog.registry import query, rounded, sql_round, whole
from retentia.catalog.segments import CONTRACT_OFFERS, HELD_SQL, OFFER_SQL, SEGMENT_SQL, _offer_columns
from retentia.operators import neighbors, recommend, segment_model
from retentia.operators.segments import FEATURES
from retentia.plans import segments as run
from retentia.session import scratch_dir
from retentia.sources import adapters as A
from retentia.sources.artifacts import ArtifactStore, Version

MONTH, SINCE = date(2024, 1, 1), date(2023, 12, 1)

# A published model: loadings of the class components and centres in scaled features.  Codes, means, deviations and
# the longest distance come from the training table.
LOADINGS = [0.1, 0.2, 0.15, 0.9, 0.5, 0.6, -0.4, -0.1]
CENTRES = [((7 * j + 3 * i + i * j) % 11 - 5) / 4 for j in range(6) for i in range(len(FEATURES))]


def published_model(spark: SparkSession, sf_dir: str) -> Version:
    """The model above, moved to the customers of a folder and read back from its store."""
    store = ArtifactStore(spark, scratch_dir(spark, "segment-store"))
    customers = A.segment_customers(spark, sf_dir)
    contracts = A.contracts(spark, sf_dir).select("ccod", F.col("target").alias("item"))
    products = A.purchases(spark, sf_dir).select("ccod", F.col("service_name").alias("item"))
    run.train(store, customers, contracts, products, loadings=LOADINGS, centres=CENTRES)
    return store.current()


def _lines(values: list[float], name: str) -> str:
    size = len(FEATURES)
    rows = [values[i : i + size] for i in range(0, len(values), size)]
    return ", ".join(f"({i}, [{', '.join(map(repr, r))}]::DOUBLE[])" for i, r in enumerate(rows)) + f") AS {name}"


def _scored_sql(rows: str, name: str) -> str:
    """Scaled vector, nearest centre and its distance of the feature rows in ``rows``."""
    vec = ", ".join(f"(t.{c} - m_{c}) / s_{c}" for c in FEATURES)
    return f"""
{name}_v AS MATERIALIZED (SELECT t.* EXCLUDE ({', '.join(FEATURES)}), [{vec}]::DOUBLE[] AS v FROM {rows} AS t, scale),
{name} AS MATERIALIZED (
  SELECT a.* EXCLUDE (d, c), c AS cluster, d FROM (
    SELECT a.*, c.c, list_distance(a.v, c.v) AS d FROM {name}_v AS a, centres AS c) AS a
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, c) = 1)"""


def _components_sql() -> str:
    codes = ["major", "mid", "minor", "detail"]
    return ", ".join(
        f"{' + '.join(f'(k.{c} - m.{c}) * {x!r}' for c, x in zip(codes, LOADINGS[4 * i : 4 * i + 4], strict=True))} AS class_pca{i + 1}"
        for i in range(2)
    )


MODEL_SQL = SEGMENT_SQL + f"""
, major AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT class_major AS l FROM base)),
mid AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT class_mid AS l FROM base)),
minor AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT class_minor AS l FROM base)),
detail AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT class_detail AS l FROM base)),
coded AS (
  SELECT ccod AS key, a.code AS major, b.code AS mid, c.code AS minor, d.code AS detail, a.code AS sido_code, b.code AS sigungu_code, c.code AS biz_type_code,
         coalesce(CASE WHEN c_nationkey <> 3 THEN 33 + c_nationkey / 5 END, 37.5) AS lat, 126 + c_nationkey % 4 AS lon,
         CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 50 END AS area
  FROM base JOIN major a ON a.l = class_major JOIN mid b ON b.l = class_mid JOIN minor c ON c.l = class_minor JOIN detail d ON d.l = class_detail),
centre AS (SELECT avg(major) AS major, avg(mid) AS mid, avg(minor) AS minor, avg(detail) AS detail FROM coded),
bucketed AS MATERIALIZED (
  SELECT k.*, {_components_sql()},
         CASE WHEN area <= 22 THEN 0 WHEN area <= 50 THEN 1 WHEN area <= 258 THEN 2 WHEN area <= 1600 THEN 3 WHEN area <= 4950 THEN 4 ELSE 5 END AS area_bucket
  FROM coded AS k, centre AS m),
scale AS MATERIALIZED (SELECT {', '.join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in FEATURES)} FROM bucketed),
centres AS MATERIALIZED (SELECT * FROM (VALUES {_lines(CENTRES, 'x(c, v)')}),{_scored_sql('bucketed', 'scored')},
longest AS (SELECT max(list_distance(a.v, c.v)) AS longest FROM scored_v AS a, centres AS c),
members AS MATERIALIZED (SELECT key AS ccod, cluster, c_name AS name, v, d FROM scored JOIN customer ON key = CAST(c_custkey AS VARCHAR)),
held AS {HELD_SQL.split('held AS', 1)[1].split('sizes AS', 1)[0].strip().rstrip(',')}
{OFFER_SQL[len(HELD_SQL):]}"""


def _payload_sql(rows: str, keys: str, first: str) -> str:
    """Recommendations of the scored rows: ``key``, cluster, d and v; ``first`` is an item not offered."""
    return f"""
, kept AS (SELECT s.key, r.item, r.usage_rate, row_number() OVER (PARTITION BY s.key ORDER BY r.usage_rate DESC, r.rank) AS place
           FROM {rows} s JOIN crated r USING (cluster) {first}),
cchoice AS (SELECT key, {CONTRACT_OFFERS} FROM kept GROUP BY key),
bkept AS (SELECT s.key, r.item, r.usage_rate, row_number() OVER (PARTITION BY s.key ORDER BY r.usage_rate DESC, r.rank) AS place
          FROM {rows} s JOIN rated r USING (cluster)),
pchoice AS (SELECT key, {_offer_columns('bkept', 'product', recommend.PRODUCT_REASON)} FROM bkept GROUP BY key),
near AS (SELECT s.key, m.ccod AS sim_ccod, m.name FROM {rows} s JOIN members m USING (cluster)
         QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY round(list_distance(s.v, m.v), 9), m.ccod) = 1),
clists AS (SELECT ccod, '["' || string_agg(DISTINCT target, '","' ORDER BY target) || '"]' AS l FROM held GROUP BY ccod),
plists AS (SELECT ccod, '["' || string_agg(DISTINCT service_name, '","' ORDER BY service_name) || '"]' AS l FROM bought GROUP BY ccod)
SELECT {keys}, '2024-01-01' AS snapshot_month, CAST(s.cluster AS BIGINT) AS user_cluster, {sql_round('1 - s.d / longest', 'cluster_similarity')},
       coalesce(sim_ccod, '') AS sim_ccod, coalesce(near.name, '') AS sim_user_name,
       coalesce(clists.l, '[]') AS sim_user_contracts, coalesce(plists.l, '[]') AS sim_user_products,
       {', '.join(f"coalesce(c.rec_contract_{i}{x}, '') AS rec_contract_{i}{x}" for i in (1, 2, 3) for x in ('', '_reason'))},
       {', '.join(f"coalesce(p.rec_product_{i}{x}, '') AS rec_product_{i}{x}" for i in (1, 2, 3) for x in ('', '_reason'))}
FROM {rows} s JOIN longest ON true LEFT JOIN cchoice c USING (key) LEFT JOIN pchoice p USING (key) LEFT JOIN near USING (key)
     LEFT JOIN clists ON clists.ccod = sim_ccod LEFT JOIN plists ON plists.ccod = sim_ccod"""


def _shown(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c.startswith(("sim_", "rec_"))]
    month = F.date_format("snapshot_month", "yyyy-MM-dd").alias("snapshot_month")
    return rows.select(*keys, month, *whole("user_cluster"), rounded("cluster_similarity"), *rest)


@query(MODEL_SQL + _payload_sql("scored", "s.key AS ccod", "LEFT JOIN firsts f ON f.ccod = s.key WHERE f.target IS DISTINCT FROM r.item"))
def recommend_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers by the published model: cluster, similarity, nearest member (self allowed), its lists, offers."""
    rows = run.recommend_customers(published_model(spark, sf_dir), A.segment_customers(spark, sf_dir), A.contracts(spark, sf_dir), MONTH)
    return _shown(rows, ["ccod"])


PROSPECT_SQL = MODEL_SQL + f""",
sites AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS kedcd, '1' AS bzpl_cd, CAST(s_suppkey % 2 AS VARCHAR) AS bzpl_seq,
         CAST(s_suppkey - s_suppkey % 2 AS VARCHAR) AS bzno, s_name AS enp_nm, r_name, n_name, s_nationkey, s_suppkey, s_acctbal
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE s_suppkey % 10 <> 4 AND s_suppkey % 60 >= 16
    AND CAST(s_suppkey - s_suppkey % 2 AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0)
  QUALIFY row_number() OVER (PARTITION BY bzno ORDER BY kedcd, bzpl_cd, bzpl_seq) = 1),
kind AS (SELECT (SELECT code FROM minor WHERE l = 'Unknown') AS minor, (SELECT code FROM detail WHERE l = 'Unknown') AS detail),
psite AS (
  SELECT bzno AS key, enp_nm, kedcd, bzpl_cd, bzpl_seq, 33 + s_nationkey / 5 AS lat,
         CASE WHEN s_suppkey % 9 <> 0 THEN 126 + s_nationkey % 4 ELSE 127 END AS lon,
         coalesce(a.code, 0) AS sido_code, coalesce(b.code, 0) AS sigungu_code, 0 AS biz_type_code,
         coalesce(a.code, 0) AS major, coalesce(b.code, 0) AS mid, coalesce(kind.minor, 0) AS minor, coalesce(kind.detail, 0) AS detail,
         CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 50 END AS area
  FROM sites LEFT JOIN major a ON a.l = r_name LEFT JOIN mid b ON b.l = n_name, kind),
pfeat AS (
  SELECT k.* EXCLUDE (major, mid, minor, detail, area), {_components_sql()},
         CASE WHEN area <= 22 THEN 0 WHEN area <= 50 THEN 1 WHEN area <= 258 THEN 2 WHEN area <= 1600 THEN 3 WHEN area <= 4950 THEN 4 ELSE 5 END AS area_bucket
  FROM psite AS k, centre AS m),{_scored_sql('pfeat', 'pscored')}"""


@query(PROSPECT_SQL + _payload_sql("pscored", "s.key AS bzno, s.enp_nm, s.kedcd, s.bzpl_cd, s.bzpl_seq", ""))
def recommend_prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospects of the month, ingested twice: the second run adds none; complete ones that aren't customers are scored."""
    version, path = published_model(spark, sf_dir), scratch_dir(spark, "prospects")
    scan = A.prospect_scan(spark, sf_dir)
    for _ in range(2):
        run.ingest_prospects(scan, path, MONTH, SINCE)
    stored, customers = run.stored_prospects(scan, path), A.segment_customers(spark, sf_dir).select("biz_no")
    rows = run.recommend_prospects(version, stored, customers, A.industries(spark, sf_dir), MONTH)
    return _shown(rows, ["bzno", "enp_nm", "kedcd", "bzpl_cd", "bzpl_seq"])


SELF_SQL = """
WITH e AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id, b.id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.cluster = b.cluster)
SELECT id, neighbor_id, {distance} FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) = 1
"""


@query(SELF_SQL.format(distance=sql_round("d", "distance")))
def nearest_in_cluster_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest member of the cluster, the member itself or an earlier copy included."""
    members = A.cluster_members(spark, sf_dir)
    return neighbors.nearest_in_cluster(members, members).select("id", "neighbor_id", rounded("distance"))


@query()
def nearest_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other member by random projections, for every member; the recall against the exact form is tested."""
    members = A.cluster_members(spark, sf_dir)
    return neighbors.hashed_in_cluster(members, members, exclude_self=True).select("id", "neighbor_id", rounded("distance"))


@query()
def segment_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on all customers with its own settings, published, loaded again and applied."""
    store = ArtifactStore(spark, scratch_dir(spark, "segment-store"))
    customers = A.segment_customers(spark, sf_dir)
    version = store.begin()
    segment_model.fit(customers, version)
    store.publish(version)
    scored = store.current().model(segment_model.PIPELINE).transform(customers)
    return scored.select("ccod", *whole("cluster"), rounded("similarity"))
