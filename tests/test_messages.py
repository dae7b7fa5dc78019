from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from retentia.functions import places, text as T
from retentia.functions.numbers import area_bucket, histogram_bin, messy_boolean, round_even
from retentia.operators import health, matching, messages as M, recontact, taxonomy
from retentia.plans import hourly

OTHER = "기타"


@pytest.fixture(scope="module")
def tax(spark):
    rows = [
        (1, "L01", "해충 문제", None, 1.0), (2, "L02", "제품", None, 1.0), (3, "L99", OTHER, None, 1.0),
        (4, "M01", "방문 요청", "L01", 2.0), (5, "M02", OTHER, "L01", 2.0), (6, "M03", "정수기", "L02", 2.0), (7, "M99", OTHER, "L99", 2.0),
        (8, "S1", "바퀴", "M01", 3.0), (9, "S2", OTHER, "M01", 3.0), (10, "S3", "누수", "M03", 3.0), (11, "S4", OTHER, "M99", 3.0),
        (12, "S5", OTHER, "M02", 3.0),
    ]
    return spark.createDataFrame(rows, "id bigint, voc_id string, name string, parent_id string, level double")


def one(spark, column, *values, ddl="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {ddl}")
    return [r[0] for r in df.select(column(F.col("v")).alias("x")).collect()]


def test_cleansing(spark):
    raw = "바퀴벌레가!!! 나와서...  해지하고 싶어요ㅠㅠ"
    assert one(spark, T.clean_words, raw) == ["바퀴벌레가 나와서 해지하고 싶어요ㅠㅠ"]
    assert one(spark, T.clean_sentence, raw, None) == ["바퀴벌레가!!! 나와서... 해지하고 싶어요", ""]
    assert one(spark, T.clean_for_model, raw) == ["바퀴벌레가 나와서 해지하고 싶어요"]
    assert one(spark, T.clean_words, "a　b\x0bc​d") == ["a b cd"]


def test_json_in_text(spark):
    texts = ['note {"a":{"b":1}} end', "no braces", "{bad", "} {"]
    assert one(spark, T.json_object, *texts) == ['{"a":{"b":1}}', None, None, None]
    answer = 'ok {"is_claim":"claim","keywords":["x"],"categories":[{"major":"m"}]} bye'
    r = one(spark, T.model_answer, answer, "nothing")
    assert (r[0]["is_claim"], r[0]["categories"][0]["major"], r[1]) == ("claim", "m", None)


def test_confidence(spark):
    got = one(spark, T.confidence, [-1.0, -2.0], [-9.0], [0.0], [], None, ddl="array<double>")
    assert got == [0.7, 0.0, 1.0, None, None]


def test_prompt(spark):
    df = spark.createDataFrame([("a!!b", "{}", "ans")], "t string, c string, r string")
    plain = df.select(T.prompt(F.col("t"), F.col("c"), "Do.")).first()[0]
    assert plain.endswith("### Response:\n") and "[Voice-of-Customer]: ab\n\n[Category Dict]\n{}\n" in plain
    trained = df.select(T.prompt(F.col("t"), F.col("c"), "Do.", F.col("r"), training=True)).first()[0]
    assert trained.endswith("### Response:\nans")


def test_addresses(spark):
    texts = ["서울특별시 강남구 역삼동", "서울 강남구 1", "세종 한솔동(1)", None, "somewhere else", "경기"]
    assert one(spark, places.province, *texts) == ["서울특별시", "서울특별시", "세종특별자치시", None, None, "경기도"]
    assert one(spark, places.district, *texts) == ["강남구", "강남구", "한솔동", None, "somewhere", None]
    compat = one(spark, lambda c: places.district(c, compat=True), *texts)
    assert compat == ["강남구", "서울", "세종", None, "somewhere", "경기"]


def test_business_types(spark):
    names = ["한식 음식점", "식품 제조", "농사", None]
    assert one(spark, places.business_type_of_industry, *names) == ["음식점업", "제조업", "기타", None]
    df = spark.createDataFrame(
        [("요식업체", None, "제조"), ("일반사업체", "병원", None), ("일반사업체", None, None), (None, None, "호텔"), ("x", "y", None)],
        "a string, b string, c string",
    )
    got = [r[0] for r in df.select(places.business_type(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["음식점업", "보건업", "기타사업체", "숙박업", "기타"]


def test_small_numbers(spark):
    areas = [22.0, 22.1, 50.0, 258.0, 1600.0, 4950.0, 4951.0, None]
    assert one(spark, area_bucket, *areas, ddl="double") == [0, 1, 1, 2, 3, 4, 5, 0]
    values = [0.0, 0.3, 1.0, 1.2, float("nan"), -0.1, 0.99]
    assert one(spark, histogram_bin, *values, ddl="double") == [0, 2, 9, None, None, None, 9]
    assert one(spark, messy_boolean, "T", "n", " 0", "1", "True", "?", None) == [True, False, False, True, True, None, None]
    assert one(spark, lambda c: round_even(c, 1), 0.25, 0.35, ddl="double") == [0.2, 0.4]


def chain(spark, tax, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, major string, mid string, minor string")
    resolved = taxonomy.resolve_chain(df, taxonomy_rows(tax))
    return [tuple(r) for r in resolved.orderBy("i").select("main.code", "sub.code", "detail.code").collect()]


def taxonomy_rows(tax):
    return tax


def test_taxonomy_fallback(spark, tax):
    got = chain(
        spark, tax,
        ("해충 문제", "방문 요청", "바퀴"),      # found
        ("해충", "방문 요청", "없음"),           # other spelling; parent's own other
        ("해충 문제", "없음", "바퀴"),           # own other on level 2, its other child
        ("없음", "방문 요청", "x"),              # level-wide other
        ("제품", "없음", "x"),                   # no own other: first other of the level
        ("제품", "정수기", "없음"),              # no own other on level 3
        (None, "방문 요청", "바퀴"), ("해충 문제", "", "바퀴"),
    )
    assert got == [
        ("L01", "M01", "S1"), ("L01", "M01", "S2"), ("L01", "M02", "S5"), ("L99", "M99", "S4"),
        ("L02", "M02", "S5"), ("L02", "M03", "S2"), (None, None, None), ("L01", None, None),
    ]


def test_slot_order_and_holes(spark, tax):
    abc, other = ("해충 문제", "방문 요청", "바퀴", "r"), (OTHER, OTHER, OTHER, "o")
    pdt = ("제품", "정수기", "누수", "p")
    df = spark.createDataFrame(
        [(1, [other, abc, abc, None, pdt]), (2, []), (3, None)],
        "msg_id bigint, categories array<struct<major:string,mid:string,minor:string,reason:string>>",
    )
    wide = M.wide_slots(M.category_slots(df, tax))
    assert len(wide.columns) == 51
    rows = {r["msg_id"]: r for r in wide.collect()}
    assert [rows[1][f"detail_category_{n}_code"] for n in range(1, 6)] == ["S1", None, "S3", "S4", None]
    assert rows[1]["detail_category_2_reason"] is None and rows[1]["detail_category_3_reason"] == "p"
    assert all(rows[2][c] is None for c in wide.columns if c != "msg_id")
    compact = M.wide_slots(M.category_slots(df, tax, compact=True)).where("msg_id = 1").first()
    assert [compact[f"detail_category_{n}_code"] for n in range(1, 6)] == ["S1", "S3", "S4", None, None]


def test_taxonomy_json_nests_in_order(spark, tax):
    tree = json.loads(taxonomy.taxonomy_json(tax))
    assert tree["해충 문제"] == {"방문 요청": ["바퀴", OTHER], OTHER: [OTHER]}
    assert list(tree) == ["해충 문제", "제품", OTHER]


def test_loading_the_taxonomy_file(spark, tmp_path):
    path = tmp_path / "tax.csv"
    path.write_bytes("voc_id,name,parent_id,level\r\nL01,해충,,1.0\r\nM01,방문,L01,2.0\r\n".encode())
    from retentia.sources import readers

    rows = taxonomy.load_taxonomy(readers.csv_dimension(spark, str(path), readers.TAXONOMY_DDL)).collect()
    assert [tuple(r) for r in rows] == [("L01", "해충", None, 1), ("M01", "방문", "L01", 2)]


def test_failing_scorer_gives_empty_answers(spark):
    def broken(texts, taxonomy_text):
        raise RuntimeError("down")

    df = spark.createDataFrame([(i, "x") for i in range(20)], "id bigint, content string")
    rows = M.score_messages(df, broken).collect()
    assert len(rows) == 20 and all(r["answer"] is None and r["confidence"] == 0.0 for r in rows)


def test_classified_message(spark, tax):
    received = spark.createDataFrame(
        [(1, "R1", "A", "독일바퀴 나왔어요 방문 바랍니다", datetime(2024, 1, 1, 10)), (2, "R2", "A", "안녕", datetime(2024, 1, 1, 10))],
        "id bigint, rcno string, ccod string, content string, received_at timestamp",
    )
    scorer = M.keyword_scorer({"바퀴": ("해충 문제", "방문 요청", "바퀴")}, ["나왔"])
    out = {r["msg_id"]: r for r in hourly.classify(received, tax, scorer, datetime(2024, 1, 1, 11)).collect()}
    assert (out[1]["is_claim"], out[1]["bug_type"], out[1]["detail_category_1_code"]) == (1, "독일바퀴", "S1")
    assert out[1]["keywords"] == '["바퀴"]' and str(out[1]["msg_received_at"]) == "2024-01-01 01:00:00"
    assert (out[2]["is_claim"], out[2]["bug_type"], out[2]["main_category_1_code"]) == (0, None, None)


def test_similar_terms_against_plain_formula(spark):
    from collections import Counter
    from math import log, sqrt
    import re

    texts = ["독일바퀴 독일바퀴 발견", "썬더블루 포획 했다", "쥐", "독일바퀴", "", "집파리 초파리 집파리"]
    terms = matching.PESTS

    def grams(t):
        w = re.findall(r"(?u)\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    def best(text):
        docs = [grams(text)] + [grams(t) for t in terms]
        df = Counter(g for d in docs for g in d)
        vec = [{g: c * (log((1 + len(docs)) / (1 + df[g])) + 1) for g, c in d.items()} for d in docs]
        norm = [sqrt(sum(x * x for x in v.values())) for v in vec]
        sims = [
            sum(vec[0].get(g, 0) * x for g, x in v.items()) / (norm[0] * n) if n and norm[0] else 0.0
            for v, n in zip(vec[1:], norm[1:])
        ]
        i = max(range(len(sims)), key=lambda j: (round(sims[j], 9), -j))
        return (terms[i], round(sims[i], 6)) if sims[i] >= 0.3 else (None, None)

    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: (r["term"], r["similarity"] and round(r["similarity"], 6)) for r in matching.best_term(df, hourly.pest_terms(spark)).collect()}
    assert got == {i: best(t) for i, t in enumerate(texts)}


def test_squared_counts(spark):
    assert one(spark, matching.sum_of_squared_counts, ["b", "a", "b", "b"], [], ddl="array<string>") == [10, 0]


def test_longest_match(spark):
    d1 = spark.createDataFrame([(1, "ring", "A1"), (2, "big ring", "A2"), (3, "xx abcd yy", "A3"), (4, "zz abcd", "A4")], "ord int, entry string, label string")
    d2 = spark.createDataFrame([(1, "ring", "B1"), (2, "exact", "B2"), (3, "car", "B3"), (4, "q", "B4")], "ord int, entry string, label string")
    df = spark.createDataFrame(
        [("one big ring",), ("abcd",), ("abc",), ("ring",), ("exact",), (" my car ",), ("q!",), (None,)], "v string"
    )
    got = [r["label"] for r in matching.longest_match(df.withColumn("i", F.monotonically_increasing_id()), "v", d1, d2).orderBy("i").collect()]
    assert got == ["A2", "A3", None, "A1", "B2", "B3", None, None]


def test_rows_and_calendar_frames(spark):
    days = [1, 2, 5, 40]
    df = spark.createDataFrame(
        [(date.fromordinal(date(2024, 1, 1).toordinal() + d - 1), "A", "c", n) for d, n in zip(days, (2, 1, 3, 1))],
        "aggregate_date date, ccod string, category_code string, daily bigint",
    )
    rows = recontact.rolling_counts(df).orderBy("aggregate_date").collect()
    assert [r["recontact_past_24h"] for r in rows] == [1, 2, 3, 3]
    assert [r["recontact_past_30d"] for r in rows] == [1, 2, 5, 6]
    rows = recontact.rolling_counts(df, "calendar").orderBy("aggregate_date").collect()
    assert [r["recontact_past_24h"] for r in rows] == [1, 2, 2, 0]
    assert [r["recontact_past_7d"] for r in rows] == [1, 2, 5, 0]
    with pytest.raises(ValueError):
        recontact.rolling_counts(df, "weeks")


def test_first_id_per_receipt(spark):
    df = spark.createDataFrame([(9, "R"), (7, "R"), (1, "S")], "id bigint, rcno string")
    got = recontact.with_message_id(spark.createDataFrame([("R",), ("T",)], "rcno string"), df)
    assert {r["rcno"]: r["msg_id"] for r in got.collect()} == {"R": 7, "T": None}


def health_rows(spark, baseline, current):
    rows = [(v, datetime(2024, 1, 5)) for v in baseline] + [(v, datetime(2024, 2, 20)) for v in current]
    return spark.createDataFrame(rows, "model_confidence double, created_at timestamp")


def test_drift(spark):
    as_of = datetime(2024, 3, 1)

    def drift(b, c):
        return health.confidence_drift(health_rows(spark, b, c), as_of, 32, 32).first()[0]

    same = [0.05, 0.3, 0.95, 1.0]
    assert drift(same, same) == pytest.approx(0.0)
    assert drift([], same) == 0.0
    assert drift([0.1], [1.2, float("nan")]) == 0.0
    from math import log

    # Halves against one full bin; the empty bin keeps 1e-10 of density 10.
    expected = 0.5 * log(0.5) + 0.5 * log(0.5 / 1e-11)
    assert drift([0.05, 0.15], [0.05, 0.05]) == pytest.approx(expected, rel=1e-6)


def test_rates_and_health_row(spark):
    t = datetime(2024, 2, 20)
    df = spark.createDataFrame(
        [(OTHER, t, t, 0.5), ("x", t, datetime(2024, 2, 21), 0.5), (None, t, t, 0.5), ("x", t, t, 0.5)],
        "main_category_1_name string, created_at timestamp, updated_at timestamp, model_confidence double",
    )
    row = health.model_health(df, datetime(2024, 3, 1), "m", "1").first()
    assert (row["unknown_rate"], row["correction_rate"], row["confidence_drift"]) == (0.25, 0.25, 0.0)
    empty = health.answer_rates(df.limit(0), datetime(2024, 3, 1)).first()
    assert tuple(empty) == (0.0, 0.0)


def test_contained_finds_all_pairs_and_stays_small(spark):
    import random

    chance = random.Random(2)
    texts = sorted({"".join(chance.choices("abcd ", k=chance.randint(1, 30))) for _ in range(150)} | {"한식당 가나다", "가나", "", "x" * 5000})
    needles = sorted({t[a : a + n] for t in texts[:80] for a in (0, 1, 3) for n in (1, 2, 3, 5, 9)} | {"zz", "가나", "xxxx"})
    rows = matching.contained(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"), 2, 4
    )
    found = sorted((r["needle"], r["text"]) for r in rows.collect())
    assert found == sorted((n, t) for n in needles for t in texts if len(n) >= 2 and n in t)
    # A long entry is cut into as many pieces as it has characters, not into all its substrings.
    long = "".join(chance.choices("abcdefgh", k=3000))
    assert spark.range(1).select(F.size(matching.pieces(F.lit(long), 4))).first()[0] <= 3000


def test_longest_match_of_long_entries(spark):
    first = spark.createDataFrame([(1, "alpha beta gamma " * 40, "long"), (2, "beta", "short")], "ord int, entry string, label string")
    second = spark.createDataFrame([(1, "delta", "d"), (2, "elt", "e")], "ord int, entry string, label string")
    rows = spark.createDataFrame([("gamma alpha",), ("a delta",), ("beta x",), ("zzz",), ("",), (None,)], "v string")
    got = {r["v"]: r["label"] for r in matching.longest_match(rows, "v", first, second).collect()}
    assert got == {"gamma alpha": "long", "a delta": "d", "beta x": "short", "zzz": None, "": None, None: None}
