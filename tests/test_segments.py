from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import churn, kmeans, neighbors, profile, recommend, sampling, segments


def brute(queries, members, exclude_self):
    out = {}
    for qid, qc, qv in queries:
        best = None
        for mid, mc, mv in members:
            if mc != qc or (exclude_self and mid == qid):
                continue
            d = float(np.sqrt(((np.array(qv) - np.array(mv)) ** 2).sum()))
            if best is None or (d, mid) < best:
                best = (d, mid)
        if best:
            out[qid] = best
    return out


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("shape", ["spread", "copies", "clumps"])
def test_nearest_equals_brute_force(spark, exclude_self, shape):
    rng = np.random.default_rng(7)
    n = 240
    if shape == "spread":
        points = rng.normal(size=(n, 3))
    elif shape == "copies":  # a third of all rows is one point
        points = rng.integers(0, 3, size=(n, 2)).astype(float)
        points[: n // 3] = 1.0
    else:
        points = rng.normal(size=(n, 2)) * 0.01 + rng.integers(0, 4, size=(n, 1)) * 100.0
    cluster = np.where(np.arange(n) % 3 == 0, 1, np.arange(n) % 2 + 1)
    cluster[-1] = 9  # alone in its cluster
    rows = [(int(i) * 3, int(c), [float(x) for x in p]) for i, (c, p) in enumerate(zip(cluster, points))]
    df = spark.createDataFrame(rows, "id bigint, cluster int, vec array<double>")
    found = neighbors.nearest_in_cluster(df, df, exclude_self=exclude_self, cell_points=10, block=7)
    got = {r["id"]: (r["distance"], r["neighbor_id"]) for r in found.collect()}
    expected = brute(rows, rows, exclude_self)
    assert got.keys() == expected.keys()
    for k, (d, m) in expected.items():
        assert got[k][0] == pytest.approx(d, abs=1e-9) and got[k][1] == m, k


def test_nearest_skips_far_cells(spark):
    """Far groups of points are not compared: that is what the pivots are for."""
    rows = [(i, 1, [float(i % 5) + 1000.0 * (i // 50), 0.0]) for i in range(400)]
    members = spark.createDataFrame(rows, "id bigint, cluster int, vec array<double>")
    queries = spark.createDataFrame([(-1, 1, [2.2, 0.0])], "id bigint, cluster int, vec array<double>")
    row = neighbors.nearest_in_cluster(queries, members, cell_points=5).first()
    assert (row["neighbor_id"], round(row["distance"], 6)) == (2, 0.2)


def groups_of_points(n, groups, dims, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 50
    points = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))
    return [(f"m{i:05d}", 1, [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("exclude_self", [True, False])
def test_nearest_compares_few_pairs_of_grouped_points(spark, exclude_self):
    """Ids are texts; with the distance found at home few other cells stay open."""
    rows = groups_of_points(4000, 40, 16)
    df = spark.createDataFrame(rows, "id string, cluster int, vec array<double>")
    counter = spark.sparkContext.accumulator(0)
    found = neighbors.nearest_in_cluster(df, df, exclude_self=exclude_self, cell_points=50, counter=counter)
    got = {r["id"]: (r["neighbor_id"], r["distance"]) for r in found.collect()}
    points = np.array([v for _, _, v in rows])
    d = np.sqrt(((points[:, None, :] - points[None, ::1, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    for i, (name, _, _) in enumerate(rows):
        assert got[name][0] == rows[int(d[i].argmin())][0] and got[name][1] == pytest.approx(d[i].min(), abs=1e-7)
    assert 0 < counter.value < 0.1 * 4000 * 4000


def test_pivots_have_a_bound(spark):
    rows = groups_of_points(3000, 10, 4)
    points = spark.createDataFrame(rows, "id string, cluster int, vec array<double>")
    pivots = neighbors._pivots(points, cell_points=1, max_pivots=20)
    assert 10 < len(pivots[1]) <= 40
    many = points.withColumn("cluster", F.col("id"))
    assert neighbors._pivots(many, cell_points=1, max_pivots=20) == {}


@pytest.mark.parametrize("exclude_self", [True, False])
def test_hashed_search_finds_nine_in_ten(spark, exclude_self):
    rows = groups_of_points(3000, 30, 16, seed=6)
    rows += [(f"c{i:03d}", 1, rows[0][2]) for i in range(300)]  # copies
    df = spark.createDataFrame(rows, "id string, cluster int, vec array<double>")
    counter = spark.sparkContext.accumulator(0)
    exact = {r["id"]: r["distance"] for r in neighbors.nearest_in_cluster(df, df, exclude_self=exclude_self).collect()}
    found = {r["id"]: r["distance"] for r in neighbors.hashed_in_cluster(df, df, exclude_self=exclude_self, counter=counter, block=500).collect()}
    assert all(d >= exact[i] - 1e-9 for i, d in found.items())
    assert sum(abs(found.get(i, np.inf) - d) < 1e-9 for i, d in exact.items()) >= 0.9 * len(exact)
    assert counter.value < 12 * 3000 * 3000 / 5


def test_codes_follow_sorted_order_and_unseen(spark):
    labels = ["b", "a", "c", "aa", "ab", "가", "나", None, "Zebra", "zebra", "a"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    codes = segments.label_codes(df, ["x"])
    got = {r["label"]: r["code"] for r in codes.collect()}
    expected = sorted({x or "Unknown" for x in labels}, key=lambda s: s.encode())
    assert got == {label: i for i, label in enumerate(expected)}
    new = spark.createDataFrame([("b",), ("never",)], "x string")
    assert [r["x_code"] for r in segments.encode_labels(new, codes, ["x"]).orderBy("x").collect()] == [got["b"], 0]


def test_standardise_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in segments.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_clusters_and_quality(spark):
    rows = [([x + dx, x], ) for x in (0.0, 10.0, 20.0) for dx in (0.0, 0.1, 0.2, 0.3)]
    df = segments.with_vector(
        spark.createDataFrame(rows, "v array<double>").select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), ["a", "b"]
    )
    model, scores = segments.choose_k(df, range(2, 5), restarts=2)
    assert len(model.clusterCenters()) == 3 and max(s.silhouette for s in scores) > 0.9
    assert min(scores, key=lambda s: s.davies_bouldin).k == 3
    assert segments.longest_center_distance(df, model) == pytest.approx(((20.15) ** 2 + 400) ** 0.5, rel=1e-6)


def test_fits_side_by_side_choose_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [([float(x) for x in p],) for p in rng.normal(size=(90, 2)) + rng.integers(0, 4, size=(90, 1)) * 8.0]
    df = segments.with_vector(
        spark.createDataFrame(rows, "v array<double>").select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), ["a", "b"]
    ).repartition(3).cache()
    one, scores = segments.choose_k(df, range(2, 6), restarts=3, parallel=1)
    many, again = segments.choose_k(df, range(2, 6), restarts=3, parallel=6)
    assert [s.k for s in scores] == [s.k for s in again] and len(one.clusterCenters()) == len(many.clusterCenters())
    assert np.allclose([s.silhouette for s in scores], [s.silhouette for s in again])
    assert np.allclose(sorted(map(tuple, one.clusterCenters())), sorted(map(tuple, many.clusterCenters())))


def test_area_under_the_curve_counts_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 400), rng.integers(0, 40, 400))]
    ones, zeros = ([s for y, s in rows if y == k] for k in (1, 0))
    won = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    df = spark.createDataFrame([*rows, (None, 3.0), (1, None)], "y int, s double").repartition(9)
    found = churn.roc_auc(df, "y", "s").first()
    assert (found["positives"], found["negatives"]) == (len(ones), len(zeros))
    assert found["roc_auc"] == pytest.approx(won / len(ones) / len(zeros), abs=1e-12)
    assert churn.roc_auc(df.where("y = 1"), "y", "s").first()["roc_auc"] is None
    assert churn.roc_auc(df.limit(0), "y", "s").first()["roc_auc"] is None


def test_pca_is_centred(spark):
    columns = ", ".join(f"{c}_code int" for c in segments.CLASS_COLUMNS)
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 0), (6, 5, 0, 0)], columns)
    out = segments.apply_class_pca(df, *segments.fit_class_pca(df))
    row = out.agg(F.round(F.sum("class_pca1"), 6), F.round(F.max(F.abs("class_pca2")), 6)).first()
    assert tuple(row) == (0.0, 0.0)


def test_top_values_and_distribution(spark):
    df = spark.createDataFrame([(1, v) for v in "aabbcdefg"] + [(2, None)], "cluster int, v string")
    assert [r["value"] for r in profile.top_values(df, "v").orderBy("rank").collect()] == ["a", "b", "c", "d", "e"]
    m = spark.createDataFrame([(1, 0), (1, 2), (1, 2)], "cluster int, n int")
    assert [tuple(r) for r in profile.length_distribution(m, "n").collect()] == [(1, 2, 2)]


def test_usage_counts_members_once(spark):
    members = spark.createDataFrame([(1, c) for c in "abcd"], "cluster int, ccod string")
    held = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, "c", "x")], "cluster int, ccod string, item string")
    assert recommend.usage_rate(held, members).first()["usage_rate"] == 75.0


def test_first_contract_orders_bad_dates_last(spark):
    df = spark.createDataFrame(
        [("A", "1", "late", "2024-02-01"), ("A", "2", "early", "20230101"), ("A", "3", "bad", "??"), ("B", "4", "only", "??"), ("C", "5", "", "20230101")],
        "ccod string, contract_no string, target string, contract_date string",
    )
    assert {r["ccod"]: r["first_target"] for r in recommend.first_contract(df).collect()} == {"A": "early", "B": "only"}


def test_offers_skip_the_first_contract(spark):
    rated = spark.createDataFrame(
        [(1, "a", 1, 10.0), (1, "b", 2, 30.0), (1, "c", 3, 30.0), (1, "d", 4, 5.0)], "cluster int, item string, rank int, usage_rate double"
    )
    customers = spark.createDataFrame([("A", 1, "b"), ("B", 1, None), ("C", 2, None)], "ccod string, cluster int, first_target string")
    rows = {r["ccod"]: [o["item"] for o in r["offers"] or []] for r in recommend.offers(customers, rated, "first_target").collect()}
    assert rows == {"A": ["c", "a", "d"], "B": ["b", "c", "a"], "C": []}
    text = recommend.offers(customers.where("ccod='A'"), rated, "first_target").select(
        *recommend.wide_offers("contract", recommend.CONTRACT_REASON, F.col("offers"))
    ).first()
    assert text["rec_contract_1_reason"] == "고객 세그먼트 내 30.0%가 이용중"


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_exact_and_repeatable(spark, partitions):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")).repartition(partitions)
    marked = sampling.stratified_split(df, "id", "y", 0.2)
    counts = {r["y"]: (r["n"], r["h"]) for r in marked.groupBy("y").agg(F.count("*").alias("n"), F.sum("held_out").alias("h")).collect()}
    assert counts == {0: (4500, 900), 1: (500, 100)}
    ids = [r["id"] for r in marked.where("held_out = 1").orderBy("id").limit(5).collect()]
    assert ids == [r["id"] for r in sampling.stratified_split(df.repartition(3), "id", "y", 0.2).where("held_out = 1").orderBy("id").limit(5).collect()]


def test_model_round_trip(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("ccod"), (F.col("id") % 2).cast("int").alias("churn"),
        (F.col("id") % 2 + (F.col("id") % 7) / 100).alias("a"), F.lit(1.0).alias("b"),
    )
    model = churn.fit_churn(df, features=["a", "b"], maxIter=3, maxDepth=2)
    means = df.groupBy("churn").agg(F.avg("a").alias("a"))
    churn.save_model(model, means, str(tmp_path / "m"))
    loaded, back = churn.load_model(spark, str(tmp_path / "m"))
    scored = churn.score(loaded, df)
    assert churn.roc_auc(scored, "churn", "churn_prob").first()["roc_auc"] == 1.0
    assert scored.where("churn <> churn_label").count() == 0 and back.count() == 2
    assert churn.importances(loaded, ["a", "b"])[1] == 0.0
    assert churn.grid_size() == 324
    with pytest.raises(ValueError):
        churn.fit_churn(df.where("churn = 1"), features=["a"])


def test_search_picks_a_model(spark):
    df = spark.range(120).select("id", (F.col("id") % 2).cast("int").alias("churn"), (F.col("id") % 2 + F.rand(1)).alias("a"))
    options = {"features": ["a"], "grid": {"maxDepth": [1, 2], "maxIter": [2]}, "weights": [1.0, 3.0], "folds": 2, "key": "id"}
    model, score = churn.search_churn(df, **options)
    assert 0.5 < score <= 1.0 and churn.score(model, df).count() == 120
    again, serial = churn.search_churn(df, **options, parallel=1)
    assert serial == score and again.stages[-1].getMaxDepth() == model.stages[-1].getMaxDepth()


def test_importance_rank(spark):
    rows = churn.importance_rank(spark, ["a", "b", "c"], [0.2, 0.5, 0.5], 2).collect()
    assert [r["feature"] for r in rows] == ["b", "c"]


def test_monthly_run_end_to_end(spark, sf_dir, tmp_path):
    from retentia.catalog.customers import feature_table
    from retentia.operators import features as X, keys
    from retentia.plans import monthly
    from retentia.session import materialise
    from retentia.sources import adapters as A

    active = monthly.active_customers(A.customers(spark, sf_dir), A.contracts(spark, sf_dir), date(2001, 1, 1), rule="all", cutoff=date(1998, 1, 1))
    assert 0 < active.count() < 150
    rows = materialise(feature_table(spark, sf_dir), "features")
    rule = {"work_last_30d": 2, "work_last_60d": 3, "work_last_90d": 5}
    model, means = monthly.train(rows, min_work=1, rule=rule, maxIter=3)
    predictions = materialise(monthly.score_customers(model, means, rows, date(2024, 1, 15)), "predictions")
    assert len(predictions.columns) == 4 + 60
    monthly.store(predictions, X.monthly_property(rows).withColumn("snapshot_month", F.lit(date(2024, 1, 1))), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/churn_prediction").count() == rows.count()
    with pytest.raises(ValueError):
        keys.require_same_keys(predictions, rows.limit(3))


def test_many_fits_share_their_passes(spark):
    """Jobs are as many as the slowest fit's steps, not the sum over the fits; every fit is at a fixed point of Lloyd."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 3)) + rng.integers(0, 5, size=(300, 1)) * 4.0
    df = segments.with_vector(spark.createDataFrame(points.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    settings = [(k, seed) for k in (2, 3, 5) for seed in range(10)]
    sc = spark.sparkContext
    sc.setJobGroup("fits", "k-means fits")
    models = kmeans.fit_all(df, settings, 100)
    sc.setJobGroup("rest", "")
    assert len(sc.statusTracker().getJobIdsForGroup("fits")) < 200
    for (k, _), model in zip(settings, models, strict=True):
        centers = np.array(model.clusterCenters())
        apart = ((points[:, None] - centers) ** 2).sum(-1)
        label = apart.argmin(1)
        assert len(centers) == k and model.cost == pytest.approx(apart.min(1).sum(), rel=1e-3)
        assert np.allclose(centers, [points[label == j].mean(0) for j in range(k)], atol=1e-3)
        assert [r["cluster"] for r in model.transform(df).collect()] == label.tolist()


def test_fits_of_few_distinct_rows(spark):
    df = segments.with_vector(spark.createDataFrame([(1.0, 2.0)] * 5 + [(3.0, 4.0)] * 5, "a double, b double"), ["a", "b"])
    model = segments.fit_clusters(df, k=4, restarts=2)
    assert sorted(map(tuple, model.clusterCenters())) == [(1.0, 2.0), (3.0, 4.0)] and model.cost == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_a_large_cell_is_not_compared_in_full(spark, exclude_self):
    """One cell of 5,000 points: a block is searched by groups, with ties and copies as in a plain search."""
    chance = np.random.default_rng(5)
    vectors = np.round(chance.normal(size=(5000, 3)), 1)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "id int, cluster int, vec array<double>")
    counter = spark.sparkContext.accumulator(0)
    found = neighbors.nearest_in_cluster(df, df, exclude_self=exclude_self, counter=counter).collect()
    assert len(found) == 5000 and counter.value < 0.2 * 5000 * 5000
    for row in found[::50]:
        apart = np.sqrt(((vectors - vectors[row["id"]]) ** 2).sum(1))
        if exclude_self:
            apart[row["id"]] = np.inf
        assert (row["distance"], row["neighbor_id"]) == (apart.min(), apart.argmin())


def test_churn_gbt_reads_the_history_once_and_moves_no_row_to_explain(spark, sf_dir, monkeypatch):
    from retentia.catalog import segments as catalog

    built, table = [], catalog.feature_table
    monkeypatch.setattr(catalog, "feature_table", lambda *a: built.append(a) or table(*a))
    monkeypatch.setitem(churn.DEFAULTS, "maxIter", 2)
    found = catalog.churn_gbt(spark, sf_dir)
    assert len(built) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert found.count() == found.select("ccod").distinct().count() == table(spark, sf_dir).count()
