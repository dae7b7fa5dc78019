from __future__ import annotations

import subprocess
import sys
from datetime import date

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentia.operators import segment_model, segments
from retentia.plans import segments as run
from retentia.schemas import PROSPECT_COLUMNS
from retentia.sources import adapters as A
from retentia.sources.artifacts import ArtifactStore

MONTH = date(2024, 1, 15)


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    customers = A.segment_customers(spark, sf_dir)
    contracts = A.contracts(spark, sf_dir).select("ccod", F.col("target").alias("item"))
    products = A.purchases(spark, sf_dir).select("ccod", F.col("service_name").alias("item"))
    return customers, contracts, products


@pytest.fixture(scope="module")
def store(spark, inputs, tmp_path_factory):
    store = ArtifactStore(spark, str(tmp_path_factory.mktemp("store")))
    run.train(store, *inputs, k=4, restarts=2, iterations=20)
    return store


def test_a_version_shows_only_when_published(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.current()
    first, second = store.begin(), store.begin()
    with pytest.raises(ValueError):
        store.publish(first)
    for version in (first, second):
        version.write(spark.range(3), "t")
    with pytest.raises(LookupError):
        store.current()
    store.publish(first)
    assert store.current().name == first.name and store.current().table("t").count() == 3
    store.publish(second)
    assert store.current().name == second.name
    store.publish(first)  # back to the first
    assert ArtifactStore(spark, str(tmp_path / "s")).current().name == first.name
    assert store.discard_old(keep=1) == [second.name] and store.current().table("t").count() == 3


def test_a_failed_fit_leaves_the_version_in_use(store, inputs):
    name = store.current().name
    customers, contracts, products = inputs
    with pytest.raises(Exception):  # noqa: B017
        run.train(store, customers.drop("lat"), contracts, products)
    assert store.current().name == name


def test_loaded_pipeline_equals_a_plain_version(spark, store, inputs):
    version = store.current()
    model = PipelineModel.load(version.path(segment_model.PIPELINE))
    labels, _, components, scale, nearest = model.stages
    rows = inputs[0].collect()
    codes = {(r["column"], r["label"]): r["code"] for r in version.table("codes").collect()}
    for c in segments.LABEL_COLUMNS:
        known = sorted({r[c] or "Unknown" for r in rows}, key=str.encode)
        assert [codes[c, x] for x in known] == list(range(len(known)))

    def code(r, c):
        return codes.get((c, r[c] or "Unknown"), 0)

    def bucket(area):
        area = 50.0 if area is None else float(area)
        return sum(area > edge for edge in (22, 50, 258, 1600, 4950))

    raw = np.array([[code(r, c) for c in segments.CLASS_COLUMNS] for r in rows], float)
    pca = (raw - raw.mean(0)) @ np.reshape(components.getOrDefault("loadings"), (2, 4)).T
    # Loadings are those of the covariance, whatever their sign.
    values, vectors = np.linalg.eigh(np.cov((raw - raw.mean(0)).T))
    for i in range(2):
        mine = np.reshape(components.getOrDefault("loadings"), (2, 4))[i]
        assert abs(abs(mine @ vectors[:, -1 - i]) - 1) < 1e-6
    x = np.array(
        [
            [37.5 if r["lat"] is None else r["lat"], 127.0 if r["lon"] is None else r["lon"], code(r, "sido"), code(r, "sigungu"),
             *p, code(r, "biz_type"), bucket(r["area"])]
            for r, p in zip(rows, pca, strict=True)
        ], float
    )
    deviation = x.std(0)
    deviation[deviation == 0] = 1
    scaled = (x - x.mean(0)) / deviation
    centres = np.reshape(nearest.getOrDefault("centres"), (-1, 8))
    apart = np.sqrt(((scaled[:, None] - centres) ** 2).sum(-1))
    assert nearest.getOrDefault("longest") == pytest.approx(apart.max())
    found = {r["ccod"]: r for r in model.transform(inputs[0]).collect()}
    for r, v, d in zip(rows, scaled, apart, strict=True):
        got = found[r["ccod"]]
        assert np.allclose(got["vec"], v) and got["cluster"] == d.argmin()
        assert got["similarity"] == pytest.approx(1 - d.min() / apart.max())


def test_unseen_and_missing_values_are_scored(spark, store):
    schema = ", ".join(f"{c} string" for c in ["ccod", *segments.LABEL_COLUMNS]) + ", lat string, lon string, area string"
    rows = spark.createDataFrame([("x", *["never seen"] * 7, "no", None, "-"), ("y", *[None] * 7, None, None, None)], schema)
    found = store.current().model(segment_model.PIPELINE).transform(rows).collect()
    assert len(found) == 2 and all(0 <= r["cluster"] < 4 for r in found)
    assert found[0]["lat"] == 37.5


SECOND_SESSION = """
import sys
sys.path.insert(0, {root!r})
from datetime import date
from retentia import session
from retentia.plans import segments as run
from retentia.sources import adapters as A
from retentia.sources.artifacts import ArtifactStore
spark = session.build("second", "local[2]", 2)
version = ArtifactStore(spark, {store!r}).current()
rows = run.recommend_customers(version, A.segment_customers(spark, {sf!r}), A.contracts(spark, {sf!r}), date(2024, 1, 15))
run.store_months(rows, {out!r})
"""


def test_scoring_in_a_second_session_gives_equal_rows(spark, store, sf_dir, tmp_path):
    import os

    out = str(tmp_path / "out")
    script = SECOND_SESSION.format(root=os.path.abspath(f"{os.path.dirname(__file__)}/.."), store=store.root, sf=sf_dir, out=out)
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300)
    mine = run.recommend_customers(store.current(), A.segment_customers(spark, sf_dir), A.contracts(spark, sf_dir), MONTH)
    theirs = spark.read.parquet(out).select(*mine.columns)
    assert mine.count() == theirs.count() == 150
    assert mine.exceptAll(theirs).isEmpty()


def test_rates_and_lists_equal_a_plain_version(spark, store, inputs):
    version = store.current()
    members = {r["ccod"]: r for r in version.table("members").collect()}
    held = [(r["ccod"], r["item"]) for r in inputs[2].collect()]
    for cluster in {r["cluster"] for r in members.values()}:
        mine = {c for c, r in members.items() if r["cluster"] == cluster}
        items = [i for c, i in held if c in mine]
        best = sorted(set(items), key=lambda i: (-items.count(i), i))[:10]
        rates = {i: len({c for c, x in held if x == i and c in mine}) / len(mine) * 100 for i in best}
        found = version.table("product_offers").where(F.col("cluster") == cluster).orderBy("rank").collect()
        assert [(r["item"], round(r["usage_rate"], 9)) for r in found] == [(i, round(rates[i], 9)) for i in best]
    one = next(iter(members))
    assert members[one]["products"] in (None, "[" + ",".join(f'"{i}"' for i in sorted({i for c, i in held if c == one})) + "]")


def test_prospects_are_stored_once(spark, sf_dir, tmp_path):
    scan, path = A.prospect_scan(spark, sf_dir), str(tmp_path / "p")
    first = run.ingest_prospects(scan, path, MONTH, date(2023, 11, 1))
    # An interrupted run: half of the rows are there already in the next month.
    assert run.ingest_prospects(scan.where("kedcd % 2 = 0"), path, date(2024, 2, 1), date(2023, 11, 1)) > 0
    assert run.ingest_prospects(scan, path, date(2024, 2, 1), date(2023, 11, 1)) > 0
    assert run.ingest_prospects(scan.unionAll(scan), path, MONTH, date(2023, 11, 1)) == 0
    stored = spark.read.parquet(path)
    counts = {str(r["snapshot_month"]): r["count"] for r in stored.groupBy("snapshot_month").count().collect()}
    assert counts == {"2024-01-01": first, "2024-02-01": first}
    assert sorted(stored.columns) == sorted(PROSPECT_COLUMNS)
    assert run.ingest_prospects(scan.limit(0), path, date(2024, 3, 1), date(2023, 11, 1)) == 0


def test_prospects_keep_their_place_and_lose_customers(spark, store, sf_dir, tmp_path):
    path = str(tmp_path / "p")
    run.ingest_prospects(A.prospect_scan(spark, sf_dir), path, MONTH, date(2023, 1, 1))
    known = spark.createDataFrame([("2",), (None,)], "biz_no string")
    rows = run.recommend_prospects(store.current(), spark.read.parquet(path), known, A.industries(spark, sf_dir), MONTH).collect()
    numbers = [r["bzno"] for r in rows]
    assert len(numbers) == len(set(numbers)) and "2" not in numbers and "4" in numbers  # 4's second site is complete
    assert all(r["sim_ccod"] and r["rec_product_1"] for r in rows)


def test_raw_rows_are_located(spark):
    rows = spark.createDataFrame([("서울특별시 강남구 테헤란로 1", "I1"), (None, None)], "addr1 string, industry_code string")
    industries = spark.createDataFrame([("I1", "한식 음식점", None, None, None, None)], "code string, name string, class_major string, class_mid string, class_minor string, class_detail string")
    found = run.located(rows, "addr1", industries).orderBy(F.col("addr1").desc_nulls_last()).collect()
    assert found[0]["sigungu"] == "강남구" and found[0]["sido"] and found[0]["biz_type"]
    assert found[1]["sido"] is None
