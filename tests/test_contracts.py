from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from retentia.operators import contracts as C
from retentia.operators.groups import next_value

AS_OF, CUTOFF = date(2024, 6, 1), date(2022, 1, 1)
DDL = (
    "ccod string, contract_no string, target string, contract_date string, start_date string, end_date string, "
    "cancel_date string, cancelled string, cancel_no string, area double"
)


def contract(ccod="A", no="1", target="t", start=None, end=None, cancel=None, flag="TRUE"):
    return (ccod, no, target, start, start, end, cancel, flag, None, 1.0)


def resolve(spark, rows, **options):
    resolved = C.resolve_contracts(spark.createDataFrame(rows, DDL), AS_OF, CUTOFF, **options)
    return {r["contract_no"]: r for r in resolved.collect()}


def day(text):
    return datetime.strptime(text, "%Y-%m-%d")


def test_explicit_cancel_wins(spark):
    r = resolve(spark, [contract(start="2023-01-01", end="2024-01-01", cancel="2023-06-01")])["1"]
    assert r["final_cancel_at"] == day("2023-06-01")
    assert r["tenure_days"] == 151


def test_renewal_uses_next_start_then_own_start(spark):
    rows = resolve(spark, [
        contract(no="1", start="2023-01-01", end="2024-01-01"), contract(no="2", start="2024-01-01", end="2025-01-01"),
    ])
    assert rows["1"]["final_cancel_at"] == day("2024-01-01")
    assert rows["2"]["final_cancel_at"] == day("2024-01-01")


def test_contract_before_cutoff_ends_at_its_end(spark):
    assert resolve(spark, [contract(start="2020-01-01", end="2021-05-01")])["1"]["final_cancel_at"] == day("2021-05-01")


def test_open_end_reads_as_null(spark):
    r = resolve(spark, [contract(start="20230101", end="99991231", flag="N")])["1"]
    assert r["end_at"] is None and r["final_cancel_at"] is None and r["open_ended"]
    df = spark.createDataFrame([contract(start="20230101", end="99991231", flag="N")], DDL)
    resolved = C.resolve_contracts(df, AS_OF, CUTOFF)
    for rule in ("any", "all"):
        assert resolved.select(C.active_flag(AS_OF, rule)).first()[0]


def test_missing_start_gets_temporary_end(spark):
    r = resolve(spark, [contract(start=None, end="2025-01-01")])["1"]
    assert r["final_cancel_at"] is None and r["logical_end_at"] == day("2024-06-01")


def test_any_and_all_rules_differ(spark):
    df = spark.createDataFrame([contract(start="2023-01-01", end="2025-01-01", flag="FALSE")], DDL)
    resolved = C.resolve_contracts(df, AS_OF, CUTOFF)
    assert resolved.select(C.active_flag(AS_OF, "any")).first()[0]
    assert not resolved.select(C.active_flag(AS_OF, "all")).first()[0]
    with pytest.raises(ValueError):
        C.active_flag(AS_OF, "some")


def test_bad_keys_are_dropped(spark):
    rows = [contract(ccod=None), contract(ccod=""), contract(ccod="TEST"), contract(ccod="B", no="9")]
    assert set(resolve(spark, rows, exclusions=("TEST",))) == {"9"}


def test_null_target_has_no_group(spark):
    df = spark.createDataFrame(
        [contract(target=None, start="2023-01-01", end="2025-01-01"),
         contract(no="2", target=None, start="2024-01-01", end="2025-01-01")], DDL)
    resolved = C.resolve_contracts(df, AS_OF, CUTOFF)
    assert resolved.where("next_start_at IS NOT NULL").count() == 0
    assert C.target_summary(resolved).count() == 0
    row = C.customer_activity(resolved, AS_OF).first()
    assert (row["unique_targets"], row["total_contracts"]) == (0, 2)


def test_customers_without_contracts_are_inactive(spark):
    customers = spark.createDataFrame([("A",), ("B",)], "ccod string")
    resolved = C.resolve_contracts(spark.createDataFrame([contract(start="2023-01-01", end="2025-01-01", flag="N")], DDL), AS_OF)
    rows = {r["ccod"]: r for r in C.customers_with_status(customers, C.customer_activity(resolved, AS_OF)).collect()}
    assert rows["A"]["status"] == 1
    assert (rows["B"]["status"], rows["B"]["unique_targets"], rows["B"]["total_contracts"]) == (0, 0, None)


def test_next_value_matches_lead_with_ties_and_nulls(spark):
    rows = [("k", 3, "c"), ("k", 1, "a"), ("k", 1, "b"), ("k", None, "z"), ("k", 5, "d"), ("o", 2, "x"), (None, 1, "q")]
    df = spark.createDataFrame(rows, "g string, v int, t string")
    got = {r["t"]: r["n"] for r in next_value(df, ["g"], "v", "t", "n").collect()}
    assert got == {"a": 1, "b": 3, "c": 5, "d": None, "z": None, "x": None, "q": None}


def test_contract_json(spark):
    text = json.dumps([{"contract_no": "1", "target": "t"}, {"contract_no": "2", "start_date": "2023-01-01", "extra": 1}])
    df = spark.createDataFrame([("A", text), ("B", None), ("C", "not json")], "ccod string, contracts_info string")
    rows = C.explode_contracts(df).where("contract_no IS NOT NULL").orderBy("contract_no").collect()
    assert [(r["ccod"], r["contract_no"], r["start_date"]) for r in rows] == [("A", "1", None), ("A", "2", "2023-01-01")]


def test_strict_status(spark):
    df = spark.createDataFrame([
        contract(no="1", start="2020-01-01", end="2021-01-01"),
        contract(no="2", target="u", start="2023-01-01", end="99991231"),
    ], DDL)
    summary = C.target_summary(C.resolve_contracts(df, AS_OF, CUTOFF))
    assert {r["target"]: r["fully_cancelled"] for r in summary.collect()} == {"t": 1, "u": 0}
    row = C.status_by_target(summary).select("targets", "cancelled_targets", "status").first()
    assert tuple(row) == (2, 1, 1)


def test_one_customer_with_most_contracts(spark):
    """A hot key gives the same answer as a plain window."""
    from pyspark.sql import Window

    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("g"),
        (F.xxhash64("id") % 700).alias("v"), F.col("id").cast("string").alias("t"),
    )
    expected = rows.withColumn("n", F.lead("v").over(Window.partitionBy("g").orderBy("v", "t")))
    for hot_rows in (None, 2):
        got = next_value(rows, ["g"], "v", "t", "n", hot_rows)
        assert got.select("g", "v", "t", "n").exceptAll(expected).count() == 0
