"""Messages: classification slots, re-contacts, text, health and streams."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.catalog.registry import day_text, query, rounded, sql_day, sql_round, whole
from retentia.functions import places
from retentia.functions import text as T
from retentia.functions.numbers import area_bucket
from retentia.operators import health, matching, messages, quality, recontact, taxonomy
from retentia.operators.groups import numbered_within
from retentia.plans import hourly
from retentia.session import materialise, scratch_dir
from retentia.sources import adapters as A
from retentia.sources import sinks
from retentia.sources.ledger import BatchLedger
from retentia.sources.readers import between
from retentia.streaming import activity, ingest

TODAY = date(2024, 1, 30)
START, MIDDLE, END = datetime(2024, 1, 1), datetime(2024, 1, 16), datetime(2024, 1, 31)
MEASURES = recontact.MEASURES

# --- re-contacts -------------------------------------------------------------

EVENTS_SQL = """
WITH ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(user_id AS VARCHAR) AS ccod FROM events),
codes AS (
  SELECT event_id, ccod, CAST(ts AS DATE) AS aggregate_date, value, unnest([event_type,
         CASE WHEN k % 2 = 0 THEN 'D' || CAST(k % 5 AS VARCHAR) END,
         CASE WHEN k % 3 = 0 THEN 'E' || CAST(k % 4 AS VARCHAR) END, NULL,
         CASE WHEN k % 11 = 0 THEN event_type END]) AS category_code
  FROM ev WHERE value >= 20),
names AS (SELECT DISTINCT event_type AS code, upper(event_type) AS category_name FROM events WHERE event_type <> 'view')
"""


def _rolling_sql(source: str, name: str, frame: str) -> str:
    spans = {"recontact_past_24h": 1, "recontact_past_3d": 2, "recontact_past_7d": 6, "recontact_past_30d": 29}
    unit = "ROWS BETWEEN {n} PRECEDING" if frame == "rows" else "RANGE BETWEEN INTERVAL {n} DAYS PRECEDING"
    sums = ", ".join(
        f"sum(daily) OVER (PARTITION BY ccod, category_code ORDER BY aggregate_date {unit.format(n=n)} AND CURRENT ROW) - 1 AS {c}"
        for c, n in spans.items()
    )
    return f"""{name}_daily AS (
  SELECT aggregate_date, ccod, category_code, count(*) AS daily FROM {source}
  WHERE category_code IS NOT NULL GROUP BY ALL),
{name} AS (SELECT aggregate_date, ccod, category_code, daily - 1 AS recontact_agg_day, {sums} FROM {name}_daily)"""


MEASURE_SQL = ", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in MEASURES)


def _recontact_sql(frame: str, where: str = "") -> str:
    return f"""{EVENTS_SQL}, {_rolling_sql('codes', 'rolled', frame)}
SELECT {sql_day('aggregate_date')}, ccod, category_code, category_name, {MEASURE_SQL}
FROM rolled LEFT JOIN names ON category_code = code {where}"""


def _recontacts(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = recontact.recontacts(
        A.messages(spark, sf_dir), A.message_category(spark, sf_dir), A.code_names(spark, sf_dir), TODAY, **options
    )
    return _shown(rows)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(day_text("aggregate_date"), "ccod", "category_code", "category_name", *whole(*MEASURES))


@query(_recontact_sql("rows"))
def recontact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recontacts(spark, sf_dir)


@query(_recontact_sql("calendar"))
def recontact_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recontacts(spark, sf_dir, frame="calendar")


@query(_recontact_sql("rows", "WHERE aggregate_date = DATE '2024-01-30'"))
def recontact_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recontacts(spark, sf_dir, only_today=True)


@query(
    f"""{EVENTS_SQL}, {_rolling_sql('codes', 'rolled', 'rows')}
SELECT count(*) AS records, count(DISTINCT ccod) AS customers, count(DISTINCT category_code) AS categories,
       count(DISTINCT aggregate_date) AS dates FROM rolled"""
)
def qa_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = quality.activity_counters(_recontacts(spark, sf_dir))
    return counters.select(*whole(*counters.columns))


UPSERT_KEYS = ["aggregate_date", "ccod", "category_code"]
FIRST_LOAD, SECOND_LOAD = "2024-02-01 00:00:00", "2024-02-02 00:00:00"


@query(
    f"""{EVENTS_SQL}, big AS (SELECT * FROM codes WHERE value >= 60),
{_rolling_sql('big', 'old', 'rows')}, {_rolling_sql('codes', 'rolled', 'rows')},
new AS (SELECT * FROM rolled WHERE aggregate_date >= DATE '2024-01-10')
SELECT strftime(coalesce(new.aggregate_date, old.aggregate_date), '%Y-%m-%d') AS aggregate_date,
       coalesce(new.ccod, old.ccod) AS ccod, coalesce(new.category_code, old.category_code) AS category_code,
       {', '.join(f"CAST(coalesce(new.{m}, old.{m}) AS BIGINT) AS {m}" for m in MEASURES)},
       CASE WHEN old.ccod IS NOT NULL THEN '{FIRST_LOAD}' ELSE '{SECOND_LOAD}' END AS created_at,
       CASE WHEN new.ccod IS NOT NULL THEN '{SECOND_LOAD}' ELSE '{FIRST_LOAD}' END AS updated_at
FROM new FULL JOIN old ON new.aggregate_date = old.aggregate_date AND new.ccod = old.ccod
     AND new.category_code = old.category_code"""
)
def voc_activity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "upsert")
    msgs, classified = A.messages(spark, sf_dir), A.message_category(spark, sf_dir)
    strict = classified.where(F.col("is_claim") == 1).join(
        A.load(spark, sf_dir, "events").where("value >= 60").select(F.col("event_id").alias("msg_id")), "msg_id", "left_semi"
    )
    for i, (source, since, stamp) in enumerate(
        [(strict, date(2024, 1, 1), FIRST_LOAD), (classified, date(2024, 1, 10), SECOND_LOAD)]
    ):
        counts = recontact.rolling_counts(recontact.daily_counts(recontact.claim_codes(msgs, source)))
        rows = counts.where(F.col("aggregate_date") >= F.lit(since))
        now = F.lit(stamp).cast("timestamp")
        sinks.upsert(rows, f"{folder}/activity", f"{folder}/staging/{i}", UPSERT_KEYS, "aggregate_date", now)
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at")]
    return spark.read.parquet(f"{folder}/activity").select(
        day_text("aggregate_date"), "ccod", "category_code", *whole(*MEASURES), *stamps
    )


@query("SELECT 'R' || CAST(event_id // 3 AS VARCHAR) AS rcno, min(event_id) AS msg_id FROM events GROUP BY 1")
def id_first_per_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recontact.first_message_per_receipt(A.messages(spark, sf_dir))


# --- taxonomy and slots ------------------------------------------------------

TAXONOMY_SQL = """
WITH t1 AS (SELECT CAST(r_regionkey AS BIGINT) AS id, 'L' || r_regionkey AS code,
       CASE WHEN r_regionkey = (SELECT max(r_regionkey) FROM region) THEN '기타' ELSE r_name END AS name FROM region),
t2 AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, 'M' || n_nationkey AS code, 'L' || n_regionkey AS parent,
       CASE WHEN n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) THEN '기타' ELSE n_name END AS name FROM nation),
t3 AS (SELECT CAST(s_suppkey + 1000 AS BIGINT) AS id, 'S' || s_suppkey AS code, 'M' || s_nationkey AS parent,
       CASE WHEN s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) THEN '기타' ELSE s_name END AS name FROM supplier)
"""


@query(
    TAXONOMY_SQL + """
SELECT t1.code AS main_code, t1.name AS main_name, t2.code AS sub_code, t2.name AS sub_name,
       coalesce(string_agg(t3.name, '|' ORDER BY t3.code), '') AS details
FROM t1 JOIN t2 ON t2.parent = t1.code LEFT JOIN t3 ON t3.parent = t2.code GROUP BY ALL"""
)
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = taxonomy.taxonomy_tree(A.taxonomy(spark, sf_dir))
    return tree.select(
        "main_code", "main_name", "sub_code", "sub_name", F.array_join(F.col("details.name"), "|").alias("details")
    )


LOOKUP_SQL = TAXONOMY_SQL + """
, picked AS (
  SELECT l_orderkey AS msg_id, l_linenumber AS n, max({'s': l_suppkey, 'q': l_quantity}) AS x
  FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL),
named AS (
  SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY n) - 1 AS pos, CAST(x.q AS INTEGER) AS q, s_name, n_name, r_name
  FROM picked JOIN supplier ON s_suppkey = x.s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
paths AS (
  SELECT msg_id, pos, 'q' || q AS reason,
         CASE WHEN q % 17 = 0 THEN NULL WHEN q % 13 = 0 THEN 'nowhere' ELSE r_name END AS major,
         CASE WHEN q % 11 = 0 THEN 'NATION_0' WHEN q % 19 = 0 THEN '' ELSE n_name END AS mid,
         CASE WHEN q % 10 = 0 THEN 'nobody' ELSE s_name END AS minor
  FROM named),
m1 AS (
  SELECT paths.*, CASE WHEN major <> '' THEN coalesce(t1.code, (SELECT code FROM t1 WHERE name = '기타' ORDER BY id LIMIT 1)) END AS main_code
  FROM paths LEFT JOIN t1 ON t1.name = major),
m2 AS (
  SELECT m1.*, CASE WHEN main_code IS NOT NULL AND mid <> '' THEN
           coalesce(e.code, o.code, (SELECT code FROM t2 WHERE name = '기타' ORDER BY id LIMIT 1)) END AS sub_code
  FROM m1 LEFT JOIN t2 e ON e.parent = main_code AND e.name = mid LEFT JOIN t2 o ON o.parent = main_code AND o.name = '기타'),
m3 AS (
  SELECT m2.*, CASE WHEN sub_code IS NOT NULL AND minor <> '' THEN
           coalesce(e.code, o.code, (SELECT code FROM t3 WHERE name = '기타' ORDER BY id LIMIT 1)) END AS detail_code
  FROM m2 LEFT JOIN t3 e ON e.parent = sub_code AND e.name = minor LEFT JOIN t3 o ON o.parent = sub_code AND o.name = '기타')
"""


@query(LOOKUP_SQL + "SELECT msg_id, CAST(pos AS BIGINT) AS pos, main_code, sub_code, detail_code FROM m3")
def taxonomy_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.model_answers(spark, sf_dir).select("msg_id", F.posexplode("categories").alias("pos", "c"))
    resolved = taxonomy.resolve_chain(rows.select("msg_id", "pos", "c.*"), A.taxonomy(spark, sf_dir))
    return resolved.select(
        "msg_id", *whole("pos"), F.col("main.code").alias("main_code"), F.col("sub.code").alias("sub_code"),
        F.col("detail.code").alias("detail_code"),
    )


def _slot_sql() -> str:
    columns = []
    for n in range(1, 6):
        for level in ("main", "sub", "detail"):
            for part in ("name", "id", "code"):
                columns.append(f"max(CASE WHEN slot = {n} AND NOT hole THEN {level}_{part} END) AS {level}_category_{n}_{part}")
        columns.append(f"max(CASE WHEN slot = {n} AND NOT hole THEN reason END) AS detail_category_{n}_reason")
    return LOOKUP_SQL + f"""
, full_names AS (
  SELECT m3.*, coalesce(t1.name, major) AS main_name, coalesce(t2.name, mid) AS sub_name, coalesce(t3.name, minor) AS detail_name,
         CAST(t1.id AS VARCHAR) AS main_id, CAST(t2.id AS VARCHAR) AS sub_id, CAST(t3.id AS VARCHAR) AS detail_id,
         main_code IS NULL AS empty
  FROM m3 LEFT JOIN t1 ON t1.code = main_code LEFT JOIN t2 ON t2.code = sub_code LEFT JOIN t3 ON t3.code = detail_code),
classed AS (
  SELECT *, CASE WHEN empty THEN 2 WHEN main_name = '기타' AND sub_name = '기타' AND detail_name = '기타' THEN 1 ELSE 0 END AS kind
  FROM full_names),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY kind, pos) AS slot,
         row_number() OVER (PARTITION BY msg_id, main_code, sub_code, detail_code ORDER BY kind, pos) AS copy
  FROM classed),
holes AS (SELECT *, copy > 1 AND NOT empty AS hole FROM placed)
SELECT msg_id, {', '.join(columns)} FROM holes GROUP BY msg_id"""


@query(_slot_sql())
def category_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = messages.wide_slots(messages.category_slots(A.model_answers(spark, sf_dir), A.taxonomy(spark, sf_dir)))
    return wide.select(*[F.col(c).cast("string").alias(c) if c.endswith("_id") and c != "msg_id" else F.col(c) for c in wide.columns])


# --- text --------------------------------------------------------------------

SPACE_SQL = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


@query(
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^가-힣a-zA-Z0-9\s.,!?]', ' ', 'g'), '\s+', ' ', 'g')) AS t
    FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c"""
)
def clean_text_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = A.load(spark, sf_dir, "documents").select("doc_id", T.clean_sentence(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    f"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9가-힣ㄱ-ㅎㅏ-ㅣ{SPACE_SQL}]', '', 'g'),
    '[{SPACE_SQL}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c"""
)
def clean_text_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = A.load(spark, sf_dir, "documents").select("doc_id", T.clean_words(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


INSTRUCTION = "Classify the message and answer in JSON."


@query(
    rf"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9가-힣ㄱ-ㅎㅏ-ㅣ{SPACE_SQL}]', '', 'g'),
    '[{SPACE_SQL}]+', ' ', 'g')) AS t FROM conversations),
    p AS (SELECT conv_id, turn, 'Below is an instruction that describes a task, paired with an input that provides further context. '
      || 'Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10)
      || ' {INSTRUCTION}' || chr(10) || chr(10) || '### Input:' || chr(10) || ' [Voice-of-Customer]: ' || t || chr(10) || chr(10)
      || '[Category Dict]' || chr(10) || role || chr(10) || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM c)
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, length(prompt) AS n, md5(prompt) AS digest FROM p"""
)
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "conversations")
    rendered = rows.withColumn("prompt", T.prompt(F.col("text"), F.col("role"), INSTRUCTION))
    return rendered.select(
        "conv_id", *whole("turn"), F.length("prompt").cast("bigint").alias("n"), F.md5("prompt").alias("digest")
    )


KEYWORDS = ["the", "tion", "ou", "zzz", "An"]


@query(
    f"""SELECT doc_id, array_to_string(list_filter({KEYWORDS} || [lang], lambda k: contains(text, k)), '|') AS kept FROM documents"""
)
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(k) for k in KEYWORDS], F.col("lang"))
    docs = A.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(T.keywords_in_text(words, F.col("text")), "|").alias("kept"))


@query(
    """WITH ev AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
    SELECT event_id, CASE k % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 3 THEN CAST(k AS VARCHAR) END AS k,
           CASE k % 5 WHEN 4 THEN CAST(k AS VARCHAR) END AS b FROM ev"""
)
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = A.event_number()
    props = F.col("props")
    noisy = (
        F.when(k % 5 == 0, F.concat(F.lit("note\n"), props, F.lit(" end")))
        .when(k % 5 == 1, F.lit("no braces"))
        .when(k % 5 == 2, F.lit("{bad} {"))
        .when(k % 5 == 3, F.concat(F.lit("} "), props, F.lit(" {x")))
        .otherwise(F.concat(F.lit('say {"a":{"b":'), k, F.lit("}} done")))
    )
    rows = A.load(spark, sf_dir, "events").select("event_id", T.json_object(noisy).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.a.b").alias("b"))


@query(
    f"""WITH lp AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)) * 60) AS p FROM embeddings)
    SELECT vec_id, {sql_round("least(1, greatest(0, (list_avg(p) + 5) / 5))", "confidence")},
           {sql_round("list_avg(list_transform(p, lambda x: exp(x)))", "mean_probability")} FROM lp"""
)
def confidence_from_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 60).alias("p")
    )
    return rows.select(
        "vec_id", rounded(T.confidence(F.col("p")), name="confidence"),
        rounded(T.mean_probability(F.col("p")), name="mean_probability"),
    )


# Spellings a customer's address may start with, and what follows.
PREFIXES = [p for spellings in places.PROVINCES.values() for p in spellings] + ["Seoul"]
ADDRESS_SQL = f"""
WITH a AS (SELECT c_custkey, ' ' || list_extract({PREFIXES}, CAST(c_custkey % {len(PREFIXES)} + 1 AS INTEGER)) || '  '
                  || c_mktsegment || '구(' || c_nationkey || ') ' || c_custkey AS address FROM customer),
p AS (SELECT *, CASE {' '.join("WHEN " + " OR ".join(f"starts_with(trim(address), '{s}')" for s in ss) + f" THEN '{name}'"
      for name, ss in places.PROVINCES.items())} END AS sido FROM a)
"""


@query(
    ADDRESS_SQL + r"""
SELECT c_custkey, sido,
       CASE WHEN sido IS NULL THEN 'Seoul' ELSE regexp_extract(address, '([A-Z]+구)\(', 1) END AS sigungu,
       CASE WHEN sido IS NULL OR NOT starts_with(trim(address), sido)
            THEN regexp_extract(trim(address), '^[^ (]+') ELSE regexp_extract(address, '([A-Z]+구)\(', 1) END AS sigungu_compat
FROM p"""
)
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(PREFIXES)
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("c_custkey") % n + 1).cast("int"))
    address = F.concat(
        F.lit(" "), prefix, F.lit("  "), "c_mktsegment", F.lit("구("), "c_nationkey", F.lit(") "), "c_custkey"
    )
    rows = A.load(spark, sf_dir, "customer").withColumn("address", address)
    return rows.select(
        "c_custkey", places.province(F.col("address")).alias("sido"), places.district(F.col("address")).alias("sigungu"),
        places.district(F.col("address"), compat=True).alias("sigungu_compat"),
    )


INDUSTRIES = [
    "한식 음식점", "종합 소매업", "식품 제조", "보습학원", "한의원", "관광호텔", "미용실 관리", "부동산 중개", "토목 시공",
    "화물 운송", "영화관", "농업", "제품 판매 식당", "빌딩 청소", "자동차 수리",
]
MAJORS = ["요식업체", "가정집", "일반사업체", "일반사업체", "일반사업체", "농가"]
MIDDLES = ["공장", "학원", "병원", "호텔", "유통", "빌딩", "복지시설", "물류창고", "서비스", "기타"]


def _any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


BUSINESS_SQL = f"""
WITH v AS (
  SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE list_extract({INDUSTRIES}, CAST(p_partkey % {len(INDUSTRIES)} + 1 AS INTEGER))
         || ' ' || p_name END AS industry,
         CASE WHEN p_size % 4 <> 0 THEN list_extract({MAJORS}, p_size % {len(MAJORS)} + 1) END AS major,
         list_extract({MIDDLES}, CAST(p_partkey % {len(MIDDLES)} + 1 AS INTEGER)) AS middle FROM part),
t AS (
  SELECT p_partkey, CASE WHEN industry IS NULL THEN NULL
         {' '.join(f"WHEN {_any_sql('industry', w)} THEN '{k}'" for k, w in places.INDUSTRY_WORDS.items())} ELSE '기타' END AS by_words,
         CASE WHEN major IS NULL THEN NULL WHEN major = '요식업체' THEN '음식점업' WHEN major = '가정집' THEN '가정/주거'
              WHEN major <> '일반사업체' THEN '기타'
         {' '.join(f"WHEN {_any_sql('middle', w)} THEN '{k}'" for k, w in places.GENERAL_WORDS)} ELSE '기타사업체' END AS by_class FROM v)
SELECT p_partkey, by_words, by_class, coalesce(by_class, by_words) AS biz_type FROM t
"""


def _pick(values: list[str], index: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(index) % len(values) + 1).cast("int"))


@query(BUSINESS_SQL)
def business_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.load(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 9 != 0, F.concat(_pick(INDUSTRIES, "p_partkey"), F.lit(" "), "p_name")).alias("industry"),
        F.when(F.col("p_size") % 4 != 0, _pick(MAJORS, "p_size")).alias("major"),
        _pick(MIDDLES, "p_partkey").alias("middle"),
    )
    major, middle, industry = F.col("major"), F.col("middle"), F.col("industry")
    return rows.select(
        "p_partkey", places.business_type_of_industry(industry).alias("by_words"),
        places.business_type_of_class(major, middle).alias("by_class"),
        places.business_type(major, middle, industry).alias("biz_type"),
    )


@query(
    """SELECT o_orderkey, CAST(CASE WHEN a <= 22 THEN 0 WHEN a <= 50 THEN 1 WHEN a <= 258 THEN 2 WHEN a <= 1600 THEN 3
    WHEN a <= 4950 THEN 4 WHEN a IS NULL THEN 0 ELSE 5 END AS BIGINT) AS bucket
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice / 2000) WHEN o_orderstatus = 'O' THEN o_totalprice / 90 END AS a FROM orders)"""
)
def area_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    area = F.when(F.col("o_orderstatus") == "P", F.round(price / 2000)).when(F.col("o_orderstatus") == "O", price / 90)
    rows = A.load(spark, sf_dir, "orders").withColumn("area", area)
    return rows.select("o_orderkey", area_bucket(F.col("area")).cast("bigint").alias("bucket"))


MATCH_SQL = """
WITH named AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS v FROM part),
vals AS (SELECT DISTINCT v FROM named),
d1 AS (SELECT entry, row_number() OVER (ORDER BY entry) AS ord, 'A:' || entry AS label FROM (SELECT DISTINCT p_name || ' ' || p_type AS entry FROM part)),
d2 AS (SELECT entry, row_number() OVER (ORDER BY entry) AS ord, 'B:' || entry AS label FROM (
         SELECT split_part(p_name, ' ', 1) AS entry FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT p_brand FROM part
         UNION SELECT p_name || ' ' || p_brand FROM part WHERE p_partkey % 10 = 1)),
s1 AS (SELECT v, label, ord, CASE WHEN contains(v, entry) AND length(entry) >= 2 THEN length(entry)
              WHEN length(v) >= 4 AND contains(entry, v) THEN length(v) END AS score FROM vals, d1),
s2 AS (SELECT v, label, ord, CASE WHEN contains(v, entry) AND length(entry) >= 2 THEN length(entry)
              WHEN length(v) >= 4 AND contains(entry, v) THEN length(v) END AS score FROM vals, d2),
b1 AS (SELECT v, label FROM s1 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v ORDER BY score DESC, ord) = 1),
b2 AS (SELECT v, label FROM s2 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v ORDER BY score DESC, ord) = 1)
SELECT p_partkey, coalesce(e1.label, e2.label, b1.label, b2.label) AS label
FROM named LEFT JOIN d1 e1 ON e1.entry = v LEFT JOIN d2 e2 ON e2.entry = v LEFT JOIN b1 USING (v) LEFT JOIN b2 USING (v)
"""


def _dictionary(entries: DataFrame, mark: str) -> DataFrame:
    """Entries numbered in their order, by many tasks."""
    numbered = numbered_within(entries.distinct().withColumn("all", F.lit(1)), "all", "entry", "ord")
    return numbered.select("ord", "entry", F.concat(F.lit(mark), "entry").alias("label"))


@query(MATCH_SQL)
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts, every other one with its brand, against all names with types, then all words, brands and some whole names."""
    part = A.load(spark, sf_dir, "part")
    branded = F.concat_ws(" ", "p_name", "p_brand")
    word = [F.split("p_name", " ")[i].alias("entry") for i in (0, 1)]
    second = part.select(word[0]).unionByName(part.select(word[1])).unionByName(part.select(F.col("p_brand").alias("entry")))
    # Exact matches of the second dictionary come before partial ones of the first.
    second = second.unionByName(part.where("p_partkey % 10 = 1").select(branded.alias("entry")))
    names = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(branded).alias("name"))
    first = part.select(F.concat_ws(" ", "p_name", "p_type").alias("entry"))
    matched = matching.longest_match(names, "name", _dictionary(first, "A:"), _dictionary(second, "B:"))
    return matched.select("p_partkey", "label")


TERMS = 122
WORD_SQL = r"[\p{L}\p{N}_]{2,}"
TFIDF_SQL = f"""
WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark),
bg AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM bw),
terms AS (SELECT g AS term, row_number() OVER (ORDER BY count(*) DESC, g) AS ord FROM bg GROUP BY g QUALIFY ord <= {TERMS}),
tg AS (SELECT ord, term, g, count(*) AS tf FROM (
         SELECT ord, term, unnest([split_part(term, ' ', 1), split_part(term, ' ', 2), term]) AS g FROM terms) GROUP BY ALL),
n AS (SELECT count(*) + 1 AS n FROM terms),
df AS (SELECT g, count(*) AS df FROM tg GROUP BY g),
mw AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM conversations),
mg AS (SELECT id, g, count(*) AS c FROM (
         SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM mw) GROUP BY ALL),
mn AS (SELECT id, sum((c * (ln((1.0 + n) / (2.0 + coalesce(df, 0))) + 1)) ** 2) AS norm2 FROM mg LEFT JOIN df USING (g), n GROUP BY id),
pairs AS (
  SELECT DISTINCT mg.id, tg.ord FROM mg JOIN tg USING (g)),
sims AS (
  SELECT p.id, tg.ord, tg.term, sum(coalesce(mg.c, 0) * tg.tf * (ln((1.0 + n) / (2.0 + df.df)) + 1) ** 2) AS dot,
         sum((tg.tf * (ln((1.0 + n) / (1.0 + df.df + CASE WHEN mg.c IS NULL THEN 0 ELSE 1 END)) + 1)) ** 2) AS tnorm2
  FROM pairs p JOIN tg ON tg.ord = p.ord JOIN df ON df.g = tg.g LEFT JOIN mg ON mg.id = p.id AND mg.g = tg.g, n GROUP BY ALL),
best AS (
  SELECT id, term, round(dot / sqrt(tnorm2 * norm2), 9) AS sim, ord FROM sims JOIN mn USING (id)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, ord) = 1)
SELECT CAST(mw.id AS BIGINT) AS id, term, coalesce(round(sim, 6), -1.0::DOUBLE) AS similarity
FROM mw LEFT JOIN (SELECT * FROM best WHERE sim >= 0.1) b ON b.id = mw.id
"""


@query(TFIDF_SQL)
def tfidf_best_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    grams = A.load(spark, sf_dir, "benchmark").select(F.explode(matching.ngrams(F.col("text"))).alias("term"))
    common = (
        grams.where(F.contains("term", F.lit(" "))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term").limit(TERMS)
    )
    terms = common.select("term", F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("ord"))
    texts = A.load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    best = matching.best_term(texts, terms, 0.1)
    return best.select("id", "term", F.coalesce(F.round("similarity", 6), F.lit(-1.0)).alias("similarity"))


# --- health ------------------------------------------------------------------

DRIFT_SQL = f"""
WITH s AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'p' ELSE 'q' END AS side, (value % 100) / 100 AS v FROM events
           WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
b AS (SELECT side, least(len(list_filter(range(0, 10), lambda i: v >= i * 0.1::DOUBLE)) - 1, 9) AS bin FROM s WHERE v BETWEEN 0 AND 1),
c AS (SELECT bin, count_if(side = 'p') AS p, count_if(side = 'q') AS q FROM b GROUP BY bin),
g AS (SELECT i AS bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM range(0, 10) t(i) LEFT JOIN c ON bin = i),
d AS (SELECT p / sum(p) OVER () * 10 + 1e-10 AS p, q / sum(q) OVER () * 10 + 1e-10 AS q FROM g),
e AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM d)
SELECT {sql_round("sum(p * ln(p / q))", "confidence_drift", 9)} FROM e
"""


@query(DRIFT_SQL)
def confidence_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = health.confidence_drift(A.message_category(spark, sf_dir), END, baseline_days=15, current_days=15)
    return value.select(rounded("confidence_drift", 9))


RATES_SQL = f"""SELECT {sql_round("avg(CAST(event_type = 'error' AS INTEGER))", "unknown_rate")},
       {sql_round("avg(CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 = 0 AS INTEGER))", "correction_rate")}
FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"""


@query(RATES_SQL)
def unknown_correction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = health.answer_rates(A.message_category(spark, sf_dir), END)
    return rates.select(rounded("unknown_rate"), rounded("correction_rate"))


@query(
    """SELECT strftime(checked_at, '%Y-%m-%d') AS checked_at, rate FROM (
       SELECT CAST(ts AS DATE) AS checked_at, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS rate FROM events GROUP BY 1)
       ORDER BY checked_at DESC LIMIT 10"""
)
def latest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.message_category(spark, sf_dir).groupBy(F.to_date("created_at").alias("checked_at")).agg(
        F.round(F.avg((F.col("main_category_1_name") == "기타").cast("int")), 6).alias("rate")
    )
    return health.latest_health(daily).select(day_text("checked_at"), "rate")


# --- the hourly run ----------------------------------------------------------

RUN_DAYS = [date(2024, 1, 10), date(2024, 1, 20), date(2024, 1, 30)]


def hourly_batches(spark: SparkSession, sf_dir: str, folder: str) -> BatchLedger:
    """The events in three batches, each up to the end of a day; the first is run twice."""
    ledger, events = BatchLedger(spark, folder), A.load(spark, sf_dir, "events")
    names = materialise(A.code_names(spark, sf_dir), "names")
    starts = [datetime(2000, 1, 1), *[datetime.combine(d + timedelta(days=1), time()) for d in RUN_DAYS]]

    def classifier(messages: DataFrame) -> DataFrame:
        mine = events.join(messages.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        return A.message_category_of(mine)

    for batch in (0, 0, 1, 2):
        received = A.messages_of(events.where(between("ts", starts[batch], starts[batch + 1])))
        hourly.run(ledger, batch, received, classifier, names, starts[batch + 1] - timedelta(seconds=1))
    return ledger


@query(_recontact_sql("rows", "WHERE aggregate_date IN (DATE '2024-01-10', DATE '2024-01-20', DATE '2024-01-30')"))
def hourly_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest, classification and refresh as committed batches: the activity table afterwards."""
    ledger = hourly_batches(spark, sf_dir, scratch_dir(spark, "hourly-run"))
    return _shown(ledger.latest(hourly.ACTIVITY, ["aggregate_date", "ccod", "category_code"]))


@query(
    """WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch
       FROM events WHERE ts < TIMESTAMP '2024-01-31')
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, count(*) AS classified, count_if(value >= 20) AS claims FROM e GROUP BY batch"""
)
def hourly_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch counted while it wrote."""
    runs = hourly_batches(spark, sf_dir, scratch_dir(spark, "hourly-run")).read(hourly.RUNS)
    return runs.select(*whole("batch", "rows", "classified", "claims"))


# --- streams -----------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = A.load(spark, sf_dir, "events").schema
    # One file or a folder of part files: a glob path takes either.
    return ingest.read_files(spark, f"{sf_dir}/events.parque[t]", schema)


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS category, count(*) AS n
    FROM events GROUP BY ALL"""
)
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "hourly")
    activity.store_hourly_counts(_event_stream(spark, sf_dir), "ts", "event_type", f"{folder}/counts", f"{folder}/checkpoint")
    counts = activity.total_counts(spark, f"{folder}/counts")
    return counts.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "category", "n")


@query(_recontact_sql("rows"))
def stream_recontact(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = activity.maintain_recontacts(
        _event_stream(spark, sf_dir), A.customer_categories_of, A.code_names(spark, sf_dir), scratch_dir(spark, "recontact"),
        F.lit(SECOND_LOAD).cast("timestamp"), since=TODAY - timedelta(days=recontact.LOOKBACK_DAYS),
    )
    return _shown(spark.read.parquet(table))


@query(DRIFT_SQL)
def stream_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = activity.collect_confidence(
        _event_stream(spark, sf_dir), A.message_category_of, START, MIDDLE, END, scratch_dir(spark, "confidence")
    )
    return value.select(rounded("confidence_drift", 9))


@query("SELECT count(DISTINCT event_id // 3) AS receipts FROM events")
def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "receipts")
    rows = A.messages_of(_event_stream(spark, sf_dir))
    ingest.store_first_arrivals(rows, f"{folder}/receipts", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/receipts").agg(F.count(F.lit(1)).alias("receipts"))
