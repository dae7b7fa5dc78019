"""Every registered query against its SQL, and the shape of the catalogue."""

from __future__ import annotations

import check
import pytest

import __spark_entry__ as entry
from retentia import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
NO_SQL = {
    "pca_2d", "kmeans_segments", "cluster_count_choice", "churn_gbt", "churn_eval", "classified_messages", "segment_model_fit",
    "nearest_by_hash",
}


def test_catalogue_is_consistent(spark):
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().items() >= ORACLES.items()
    assert entry.entry(spark).count() == 150


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert check.compare(QUERIES[name](spark, sf_dir).toPandas(), check.oracle_frame(con, ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir).toPandas()
    assert len(frame) > 0
    if "churn_prob" in frame:
        assert frame["churn_prob"].between(0, 1).all() and len(frame) == 150
    if "similarity" in frame:
        assert frame["similarity"].between(0, 1).all()
    if name == "nearest_by_hash":
        exact = QUERIES["nearest_in_cluster"](spark, sf_dir).toPandas().set_index("id")["distance"]
        found = frame.set_index("id")["distance"].reindex(exact.index)
        assert (found.fillna(9.9) >= exact - 1e-6).all() and ((found - exact).abs() < 1e-6).mean() >= 0.9
