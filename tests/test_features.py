from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from retentia.operators import explain, features as X, groups
from retentia.schemas import COUNT_FEATURES, CSI_FEATURES, MODEL_FEATURES, VOC_FEATURES, WORK_FEATURES

WORKS = (
    "ccod string, work_at timestamp, work_type string, confirmed boolean, cancelled boolean, "
    "n_services bigint, csi_sum double, csi_count int"
)
LAST = datetime(2024, 3, 31, 1)


def test_feature_lists():
    assert (len(WORK_FEATURES), len(CSI_FEATURES), len(VOC_FEATURES)) == (29, 8, 16)
    assert (len(MODEL_FEATURES), len(COUNT_FEATURES)) == (57, 33)
    assert set(explain.DISPLAY_NAMES) == set(MODEL_FEATURES)


def test_window_is_floor_of_elapsed_days(spark):
    ages = [timedelta(0), timedelta(days=30), timedelta(days=30, hours=23), timedelta(days=31)]
    rows = [("A", LAST - a, "t", True, False, 2, 0.0, 0) for a in ages]
    r = X.work_features(spark.createDataFrame(rows, WORKS)).first()
    assert (r["work_last_30d"], r["work_last_60d"], r["work_count"], r["services_30d"]) == (3, 4, 4, 6)
    assert r["work_span_days"] == 31


def test_undated_work_counts_for_life_only(spark):
    rows = [("A", None, "x", True, False, 5, 4.0, 1), ("A", LAST, "y", False, True, 1, 3.0, 1)]
    r = X.work_features(spark.createDataFrame(rows, WORKS)).first()
    assert (r["confirmed_work"], r["confirmed_90d"], r["unique_work_types"], r["work_types_30d"]) == (1, 0, 2, 1)
    assert (r["avg_csi_score"], r["csi_survey_count"], r["avg_services_per_work"]) == (3.0, 1, 3.0)


def test_empty_type_is_no_type(spark):
    rows = [("A", LAST, "", None, None, 0, 0.0, 0), ("A", LAST, None, True, False, 0, 0.0, 0)]
    r = X.work_features(spark.createDataFrame(rows, WORKS)).first()
    assert (r["work_count"], r["unique_work_types"], r["confirmed_work"]) == (2, 0, 1)


def test_children_are_counted_per_work(spark):
    works = spark.createDataFrame([("w1", "A"), ("w2", "A")], "work_no string, ccod string")
    services = spark.createDataFrame([("w1",), ("w1",)], "work_no string")
    surveys = spark.createDataFrame([("w1", "4.5"), ("w1", "n/a"), ("w1", None)], "work_no string, csi_score string")
    rows = {r["work_no"]: r for r in X.attach_children(works, services, surveys).collect()}
    assert (rows["w1"]["n_services"], rows["w1"]["csi_sum"], rows["w1"]["csi_count"]) == (2, 4.5, 1)
    assert (rows["w2"]["n_services"], rows["w2"]["csi_count"]) == (0, 0)


def test_no_history_is_all_zero(spark):
    customers = spark.createDataFrame([("A",)], "ccod string")
    work = X.work_features(spark.createDataFrame([], WORKS))
    voc = X.voc_features(spark.createDataFrame([], "ccod string, event_type string, event_at timestamp"))
    r = X.customer_features(customers, work, voc).first()
    assert all(r[f] == 0 for f in MODEL_FEATURES)
    assert work.columns == ["ccod", *WORK_FEATURES, *CSI_FEATURES]


def test_interaction_json_dates(spark):
    text = '[{"event_type":"VOC","event_date":"2024-01-01"},{"event_type":"X","event_date":"","date":"20240301"},{"event_type":"VOC"}]'
    df = spark.createDataFrame([("A", text), ("B", None)], "ccod string, interaction_history string")
    r = X.voc_features(X.explode_interactions(df)).first()
    assert (r["num_interactions"], r["voc_count"], r["interactions_30d"], r["interactions_60d"], r["voc_60d"]) == (3, 2, 1, 2, 1)


def test_windows_grow_and_rates_are_shares(spark, sf_dir):
    from retentia.catalog.customers import feature_table

    f = feature_table(spark, sf_dir)
    for stem in ("work_last", "confirmed", "services", "work_types", "interactions", "voc", "csi_survey_count"):
        assert f.where(f"{stem}_30d > {stem}_60d OR {stem}_60d > {stem}_90d").count() == 0
    rates = [c for c in MODEL_FEATURES if "rate_" in c and "change" not in c]
    assert f.where(" OR ".join(f"{c} < 0 OR {c} > 1" for c in rates)).count() == 0


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_same_result_for_any_partitioning(spark, sf_dir, partitions):
    from retentia.catalog.customers import feature_table

    def total():
        row = feature_table(spark, sf_dir).agg(*[F.round(F.sum(f), 6).alias(f) for f in MODEL_FEATURES]).first()
        return row.asDict()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        expected = total()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert total() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_customer_is_spread(spark, monkeypatch):
    """Two thirds of the rows on one key: spread over tasks, same totals."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 100)).alias("ccod"),
        (F.lit(LAST) - F.make_dt_interval((F.col("id") % 200).cast("int"))).alias("work_at"),
        (F.col("id") % 5).cast("string").alias("work_type"), (F.col("id") % 2 == 0).alias("confirmed"),
        F.lit(False).alias("cancelled"), F.lit(1).cast("bigint").alias("n_services"), F.lit(0.0).alias("csi_sum"),
        F.lit(0).alias("csi_count"),
    )
    plain = X.work_features(rows).orderBy("ccod").collect()
    monkeypatch.setattr(groups, "HOT_ROWS", 100)
    split = X.work_features(rows)
    assert split.orderBy("ccod").collect() == plain
    assert "_salt" in split._jdf.queryExecution().toString()
    joined = groups.with_group_stats(rows, ["ccod"], m=F.max("work_at")).select(F.spark_partition_id().alias("p"), "ccod")
    loads = [r["n"] for r in joined.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert max(loads) < 20_000  # the hot key alone has 20,000 rows


def test_label_and_training_rows(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 9), (0, 0, 5)], "work_last_30d int, work_last_60d int, work_last_90d int")
    assert [r["churn"] for r in df.withColumn("churn", X.churn_label()).collect()] == [1, 0, 0]
    assert X.training_rows(df, 5).count() == 2


def test_explanation_matches_hand_calculation(spark):
    names = ["confirmed_90d", "voc_30d", "avg_csi_score"]
    df = spark.createDataFrame([("A", 1.0, 2.0, 3.0), ("B", 3.0, 2.0, 5.0)], "ccod string, " + ", ".join(f"{n} double" for n in names))
    top = {r["ccod"]: r["top"] for r in explain.top_contributions(df, [1.0, 1.0, 0.5], names, k=2).collect()}
    z = 1 / 2**0.5
    assert [t["feature"] for t in top["B"]] == ["avg_csi_score", "confirmed_90d"]
    assert top["B"][0]["contribution"] == pytest.approx(0.5 * z * 6.0)
    assert top["A"][1]["contribution"] == pytest.approx(-z * 0.01)


def test_diverse_variant_and_weights(spark):
    base = {f: 1.0 for f in MODEL_FEATURES}
    rows = [{"ccod": c, **base, "confirmed_90d": v} for c, v in (("A", 0.0), ("B", 10.0))]
    df = spark.createDataFrame(rows)
    out = {r["ccod"]: r for r in explain.scoring_variant(df).collect()}
    from math import log

    cap = 5 + 0.5 * 50**0.5
    assert out["B"]["confirmed_90d"] == pytest.approx(0.1 * log(1 + cap))
    assert out["A"]["cancelled_60d"] == 2.5 and out["A"]["csi_score_30d"] == 0.5
    weights = {f: explain.diversity_weight(f) for f in MODEL_FEATURES}
    assert weights["confirmation_rate_change"] == 5.0 and weights["activity_density"] == 2.0
    assert weights["csi_survey_count_60d"] == 6.0 and weights["voc_ratio"] == 2.0 and weights["work_last_90d"] == 2.0
    assert explain.scoring_variant(df, "capped").select("confirmed_90d").agg(F.max("confirmed_90d")).first()[0] == 10
    with pytest.raises(ValueError):
        explain.scoring_variant(df, "other")


def test_features_from_increments_equal_those_from_scratch(spark, tmp_path):
    """Rows in any order of arrival, without dates, late within and beyond the windows."""
    import random

    from retentia.operators import history

    chance = random.Random(9)
    rows = []
    for i in range(900):
        at = None if i % 40 == 0 else LAST - timedelta(hours=chance.randint(0, 24 * 400))
        rows.append(
            (f"c{chance.randint(0, 25)}", at, chance.choice(["a", "b", "", None]), chance.random() < 0.5, chance.random() < 0.2,
             chance.randint(0, 3), float(chance.randint(0, 9)), chance.randint(0, 1))
        )
    schema = "ccod string, work_at timestamp, work_type string, confirmed boolean, cancelled boolean, n_services long, csi_sum double, csi_count int"
    whole = X.work_features(spark.createDataFrame(rows, schema)).orderBy("ccod").collect()
    parts = [rows[i::4] for i in range(4)]
    parts.sort(key=lambda p: min(str(r[1]) for r in p))
    months = [date(2024, m, 1) for m in range(1, 5)]
    for n, part in enumerate(parts):
        for _ in range(2):  # a repeated run changes nothing
            moments = X.work_moments(spark.createDataFrame(part, schema))
            state = history.advance_month(spark, str(tmp_path), months[n - 1] if n else None, months[n], moments, X.WORK)
    found = X.work_features_of(state.by_kind(X.WORK)).orderBy("ccod").collect()
    assert len(found) == len(whole)
    for a, b in zip(found, whole, strict=True):
        assert a.ccod == b.ccod and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a[1:], b[1:], strict=True))
    # Old moments are gone from what the next month reads.
    assert state.recent.agg(F.min("at")).first()[0] >= LAST - timedelta(days=400 + 91)
    assert 0 < state.recent.count() < len(rows)


def test_history_is_scanned_once(spark, sf_dir):
    from retentia.catalog.customers import feature_table
    from retentia.sources import adapters as A

    plan = X.work_moments(A.work_orders(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert "lineitem.parquet" not in feature_table(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_incremental_months_read_only_what_arrived(spark, sf_dir, tmp_path, monkeypatch):
    from retentia.catalog import customers
    from retentia.operators import history

    read, advance_month = [], history.advance_month
    monkeypatch.setattr(history, "advance_month", lambda *a, **k: read.append(a[4].inputFiles()) or advance_month(*a, **k))
    customers.incremental_features(spark, sf_dir, str(tmp_path))
    assert len(read) == 2 * len(customers.PARTS)
    assert not any(name in f for files in read for f in files for name in ("lineitem.parquet", "orders.parquet"))
