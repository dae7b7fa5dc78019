from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia import session
from retentia.catalog import voc
from retentia.operators import keys, quality, recontact
from retentia.operators.groups import Children, nest, pack, top_per_group, with_group_stats
from retentia.schemas import require_columns
from retentia.sources import adapters as A
from retentia.sources import jdbc, readers, sinks
from retentia.streaming import activity, ingest


def test_huge_parent_is_cut_in_parts_and_stays_whole(spark):
    parent = spark.createDataFrame([("hot",), ("cold",), ("none",)], "k string")
    child = spark.range(100).select(F.when(F.col("id") < 95, "hot").otherwise("cold").alias("k"), F.col("id").alias("v"))
    rows = nest(parent, ["k"], [Children(child, "items", ["v"], ["v"])], 10).collect()
    hot = [r for r in rows if r["k"] == "hot"]
    assert len(hot) > 5 and sorted(x["v"] for r in hot for x in r["items"]) == list(range(95))
    assert all([x["v"] for x in r["items"]] == sorted(x["v"] for x in r["items"]) for r in rows)
    assert [(r["k"], r["part"], len(r["items"])) for r in rows if r["k"] != "hot"] in (
        [("cold", 0, 5), ("none", 0, 0)], [("none", 0, 0), ("cold", 0, 5)]
    )


def test_several_lists_share_parts(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    many = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, w string")
    rows = nest(parent, ["k"], [Children(many, "m", ["v"], ["v"]), Children(few, "f", ["w"], ["w"])], 10).collect()
    assert sum(len(r["m"]) for r in rows) == 50 and sum(len(r["f"]) for r in rows) == 2
    assert len({(r["k"], r["part"]) for r in rows}) == len(rows)


def test_weight_decides_the_number_of_parts(spark):
    child = spark.createDataFrame([("a", i, 100) for i in range(20)], "k string, v int, w int")
    assert pack(Children(child, "m", ["v"], ["v"]), ["k"], 500).count() == 1
    assert pack(Children(child, "m", ["v"], ["v"], F.col("w")), ["k"], 500).count() > 1


def test_rank_filter_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    top = top_per_group(df, ["k"], [F.desc("v")], 3)
    assert sorted(r["v"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_hot_parents_are_salted(spark):
    child = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    rows = pack(Children(child, "m", ["v"], ["v"]), ["k"], 10).collect()
    assert len(rows) > 10 and sorted(x["v"] for r in rows for x in r["m"]) == list(range(200))


def test_group_stats_use_no_window(spark):
    df = with_group_stats(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), ["k"], m=F.max("id"))
    assert "Window" not in df._jdf.queryExecution().toString()
    assert {(r["k"], r["m"]) for r in df.collect()} == {(0, 8), (1, 9)}


def test_upsert_keeps_created_and_survives_a_repeat(spark, tmp_path):
    table, ddl = str(tmp_path / "t"), "d date, k string, n int"
    t1, t2 = F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 2))
    day, other = date(2024, 1, 5), date(2024, 1, 6)

    def put(rows, stage, now):
        sinks.upsert(spark.createDataFrame(rows, ddl), table, str(tmp_path / stage), ["d", "k"], "d", now)

    put([(day, "a", 1), (day, "b", 2), (other, "c", 3)], "s1", t1)
    for _ in range(2):
        put([(day, "a", 10), (day, "z", 4)], "s2", t2)
    rows = {r["k"]: r for r in spark.read.parquet(table).collect()}
    assert {k: r["n"] for k, r in rows.items()} == {"a": 10, "b": 2, "c": 3, "z": 4}
    assert (rows["a"]["created_at"].day, rows["a"]["updated_at"].day) == (1, 2)
    assert (rows["b"]["created_at"].day, rows["b"]["updated_at"].day) == (1, 1)
    assert rows["z"]["created_at"].day == 2


def test_month_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    for m in (1, 2):
        sinks.write_months(spark.range(3).withColumn("snapshot_month", F.lit(date(2024, m, 1))), path)
    one = readers.month_partition(spark, path, date(2024, 2, 17))
    assert one.count() == 3 and "PartitionFilters: [isnotnull(snapshot_month" in one._jdf.queryExecution().toString()


def test_csv_and_empty_text(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", "x")], "id string, v string")
    assert [r["v"] for r in sinks.empty_to_null(df).orderBy("id").collect()] == [None, "x"]
    sinks.export_csv(df, str(tmp_path / "c"))
    assert readers.csv_dimension(spark, str(tmp_path / "c"), "id string, v string").count() == 2


def test_examples_from_json(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"input_text":"a","category_dict":"{}","response":"r"},\n {"input_text":"b"}]')
    (tmp_path / "e.jsonl").write_text('{"input_text":"a"}\n{"input_text":"b"}\n')
    for name in ("e.json", "e.jsonl"):
        rows = readers.examples(spark, str(tmp_path / name)).collect()
        assert [r["input_text"] for r in rows] == ["a", "b"] and rows[1]["response"] is None


def test_jdbc_options_and_templates():
    profile = jdbc.Profile("jdbc:x://h/db", "org.x.Driver", "reader", {"password": "p"})
    assert "password" not in repr(profile)
    start, end = jdbc.last_hour(datetime(2024, 1, 1, 10))
    sql = jdbc.bind("messages", start=start, end=end)
    assert "indt >= '2024-01-01 09:00:00' AND indt < '2024-01-01 10:00:00'" in sql
    plain = jdbc.options(profile, sql)
    assert plain["query"] == sql and plain["password"] == "p" and "dbtable" not in plain
    split = jdbc.options(profile, sql, "id", (0, 100), 4)
    assert split["dbtable"].endswith(") q") and split["numPartitions"] == "4" and "query" not in split
    with pytest.raises(ValueError):
        jdbc.bind("contracts", as_of="x'; drop")
    with pytest.raises(ValueError):
        jdbc.options(profile, sql, "id")


def test_fixed_schema_is_checked(spark):
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), ["id", "x"], "t")


def test_key_checks(spark):
    a = spark.createDataFrame([("1",), ("1",), ("2",)], "ccod string")
    b = spark.createDataFrame([("2",), ("3",)], "ccod string")
    assert tuple(keys.key_difference(a, b).first()) == (3, 2, 1, 1)
    assert tuple(keys.coverage(a, b).first()) == (1, 1)
    assert keys.key_difference(a.limit(0), b.limit(0)).first()[0] == 0
    with pytest.raises(ValueError):
        keys.require_same_keys(a, b)


def test_prospects(spark):
    p = spark.createDataFrame(
        [("1", "x", date(2024, 1, 5)), ("2", None, date(2024, 1, 5)), ("3", "y", date(2023, 1, 5)), ("4", "z", date(2024, 1, 9))],
        "bzno string, enp_nm string, registered_at date",
    )
    c = spark.createDataFrame([("4",), (None,)], "biz_no string")
    rows = keys.eligible_prospects(p, c, ["bzno", "enp_nm"], since=date(2024, 1, 1)).collect()
    assert [r["bzno"] for r in rows] == ["1"]


def test_similarity_counters(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "similarity double")
    assert tuple(quality.similarity_counters(df).first()) == (0.5, 0.5, 0.1, 0.9)


def test_scratch_dir_follows_the_cluster_setting():
    class Session:
        class sparkContext:
            master = "yarn"

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder}

    assert session.scratch_dir(Session("s3://shared/x/"), "n").startswith("s3://shared/x/n-")
    with pytest.raises(ValueError):
        session.scratch_dir(Session(""), "n")


# --- streams over several batches --------------------------------------------


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    events = A.load(spark, sf_dir, "events")
    folder = str(tmp_path / "events")
    # Arrival order differs from event order within the lateness bound.
    for i, part in enumerate(events.withColumn("b", F.pmod(F.hash("event_id"), F.lit(3))).randomSplit([1.0, 1.0, 1.0], 3)):
        part.drop("b").coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def test_stream_recontact_equals_batch(spark, sf_dir, event_files, tmp_path):
    folder, events = event_files
    rows = ingest.read_files(spark, folder, events.schema, files_per_batch=1)
    since = voc.TODAY - timedelta(days=recontact.LOOKBACK_DAYS)
    table, progress = activity.maintain_recontacts(
        rows, A.customer_categories_of, A.code_names(spark, sf_dir), str(tmp_path / "s"), F.lit(datetime(2024, 2, 1)), since=since
    )
    # A batch touches the state of its own keys only.
    files = sorted(progress, key=lambda p: p["batchId"])
    keys = A.customer_categories_of(events)
    all_keys = recontact.claim_days(keys, since).select("ccod", "category_code").distinct().count()
    state = [p["stateOperators"][0] for p in files]
    assert len(state) == 3 and all(0 < s["numRowsUpdated"] <= all_keys for s in state)
    assert state[0]["numRowsUpdated"] == state[0]["numRowsTotal"] <= state[2]["numRowsTotal"] == all_keys
    expected = recontact.recontacts(
        A.messages(spark, sf_dir), A.message_category(spark, sf_dir), A.code_names(spark, sf_dir), voc.TODAY
    )
    columns = ["aggregate_date", "ccod", "category_code", "category_name", *recontact.MEASURES]
    got = spark.read.parquet(table).select(*columns)
    assert got.count() == expected.count() and got.exceptAll(expected.select(*columns)).count() == 0


def test_stream_confidence_equals_batch(spark, event_files, tmp_path):
    from retentia.operators import health

    folder, events = event_files
    rows = ingest.read_files(spark, folder, events.schema, files_per_batch=1)
    streamed = activity.collect_confidence(rows, A.message_category_of, voc.START, voc.MIDDLE, voc.END, str(tmp_path / "c")).first()[0]
    batch = health.confidence_drift(A.message_category_of(events), voc.END, 15, 15).first()[0]
    assert streamed == pytest.approx(batch, abs=1e-12)


def test_late_files_and_late_repeats_count(spark, sf_dir, tmp_path):
    events = A.load(spark, sf_dir, "events").withColumn("_p", F.ntile(4).over(Window.orderBy(F.desc("ts"))))
    folder = str(tmp_path / "events")
    for n in range(1, 5):  # newest first, one file per batch
        events.where(F.col("_p") == n).drop("_p").coalesce(1).write.mode("append").parquet(folder)
    rows = ingest.read_files(spark, folder, events.drop("_p").schema, files_per_batch=1)
    activity.store_hourly_counts(rows, "ts", "event_type", str(tmp_path / "h"), str(tmp_path / "hc"))
    got = activity.total_counts(spark, str(tmp_path / "h"))
    expected = activity.hourly_counts(events.drop("_p"), "ts", "event_type")
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0

    ingest.store_first_arrivals(A.messages_of(rows), str(tmp_path / "r"), str(tmp_path / "rc"))
    kept = spark.read.parquet(str(tmp_path / "r"))
    assert kept.count() == A.messages_of(events).select("rcno").distinct().count()


def test_windowed_confidence_counts_all(spark, event_files, tmp_path):
    folder, events = event_files
    rows = ingest.read_files(spark, folder, events.schema).withColumn("v", (F.col("value") % 100) / 100)
    ingest.run_available(activity.windowed_confidence(rows, "ts", "v"), str(tmp_path / "ck"), ingest.keep_batch(str(tmp_path / "o")), "update")
    assert spark.read.parquet(str(tmp_path / "o")).agg(F.sum("n")).first()[0] == events.count()


def test_restarted_stream_reads_nothing_twice(spark, event_files, tmp_path):
    folder, events = event_files
    for _ in range(2):
        rows = ingest.read_files(spark, folder, events.schema)
        ingest.run_available(rows.select("event_id"), str(tmp_path / "ck"), ingest.keep_batch(str(tmp_path / "o")))
    assert spark.read.parquet(str(tmp_path / "o")).count() == events.count()


@pytest.mark.parametrize("frame", ["rows", "calendar"])
def test_recount_equals_a_plain_version(frame):
    import random

    chance = random.Random(4)
    for _ in range(300):
        days = {d: chance.randint(1, 4) for d in chance.sample(range(120), chance.randint(1, 60))}
        touched = chance.sample(sorted(days), chance.randint(1, min(3, len(days))))
        found = {r[0]: r[1:] for r in activity.recount(days, touched, frame, 35)}
        for day in days:
            near = [d for d in sorted(days) if day - 35 <= d <= day]
            spans = [near[-n - 1 :] if frame == "rows" else [d for d in near if d >= day - n] for n in recontact.FRAMES.values()]
            wanted = (days[day] - 1, *[sum(days[d] for d in s) - 1 for s in spans])
            if min(touched) <= day <= max(touched) + 35:
                assert found[day] == wanted
            else:
                assert day not in found


def test_state_batches_touch_their_keys_and_late_rows_count(spark, tmp_path):
    """Three batches: most keys, then two late rows of one key, then a repeat of old receipts."""
    schema = "ccod string, created_at timestamp, is_claim int, rcno string, " + ", ".join(f"{c} string" for c in recontact.CODE_COLUMNS)

    def rows(pairs):
        return spark.createDataFrame([(c, datetime(2024, 1, d), 1, f"{c}-{d}", "E", None, None, None, None) for c, d in pairs], schema)

    batches = [[(f"c{i}", 20) for i in range(50)], [("c1", 1), ("c1", 19)], [("c1", 20), ("c2", 20), (None, 3)]]
    folder = str(tmp_path / "in")
    for batch in batches:
        rows(batch).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.read_files(spark, folder, rows(batches[0]).schema, files_per_batch=1)
    names = spark.createDataFrame([("E", "error")], "voc_id string, name string")
    table, progress = activity.maintain_recontacts(stream, lambda r: r, names, str(tmp_path / "s"), F.lit(datetime(2024, 2, 1)))
    assert sorted(p["stateOperators"][0]["numRowsUpdated"] for p in progress) == [1, 3, 50]
    everything = [x for b in batches for x in b]
    days = recontact.claim_days(rows(everything))
    wanted = recontact.rolling_counts(recontact.daily_counts(days))
    columns = ["aggregate_date", "ccod", "category_code", *recontact.MEASURES]
    got = spark.read.parquet(table).select(*columns)
    assert got.count() == wanted.count() and got.exceptAll(wanted.select(*columns)).isEmpty()
    seen = ingest.store_first_arrivals(stream, str(tmp_path / "r"), str(tmp_path / "rc"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == len(set(everything))
    assert sorted(p["stateOperators"][0]["numRowsUpdated"] for p in seen) == [1, 2, 50]


def test_state_of_many_keys_takes_no_python_call_per_key(spark, tmp_path):
    """State is kept by Spark's aggregation; a day that comes again counts, and days out of reach aren't written again."""
    schema = "ccod string, created_at timestamp, is_claim int, " + ", ".join(f"{c} string" for c in recontact.CODE_COLUMNS)

    def rows(days):
        return spark.createDataFrame([(f"c{i}", datetime(2024, m, d), 1, "E", "F", None, None, None) for i in range(20) for m, d in days], schema)

    batches, folder = [[(1, 1), (1, 5), (3, 20)], [(1, 5), (1, 5), (1, 9)], [(1, 1), (1, 9)]], str(tmp_path / "in")
    for batch in batches:
        rows(batch).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.read_files(spark, folder, rows(batches[0]).schema, files_per_batch=1)
    names = spark.createDataFrame([("E", "error")], "voc_id string, name string")
    table, progress = activity.maintain_recontacts(stream, lambda r: r, names, str(tmp_path / "s"), F.lit(datetime(2024, 4, 1)), "calendar")
    assert {p["stateOperators"][0]["operatorName"] for p in progress} == {"stateStoreSave"}
    staged = {n: spark.read.parquet(f"{tmp_path}/s/staging/{n}/updates").groupBy("aggregate_date").count().collect() for n in range(3)}
    far = {n: [r for r in s if r["aggregate_date"].month == 3] for n, s in staged.items()}
    assert len(far[0]) == 1 and not far[1] and not far[2]
    wanted = recontact.rolling_counts(recontact.daily_counts(recontact.claim_days(rows(sum(batches, [])))), "calendar")
    columns = ["aggregate_date", "ccod", "category_code", *recontact.MEASURES]
    got = spark.read.parquet(table).select(*columns)
    assert got.count() == wanted.count() == 160 and got.exceptAll(wanted.select(*columns)).isEmpty()
