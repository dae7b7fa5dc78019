"""Text against dictionaries: TF-IDF similarity and longest substring.

Both are equi-joins on pieces of text, so the work grows with the text and not
with text times dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.arrays import let
from retentia.functions.text import WORD
from retentia.operators.groups import join_back
from retentia.session import materialise

# Pests looked for when the model names none, in match order.
PESTS = [
    "쥐", "바퀴", "개미", "저곡해충", "진드기", "먼지다듬이", "고양이", "거미", "집게벌레", "파리", "모기",
    "하루살이", "화랑곡나방", "나방", "미동정", "기타", "집웅쥐", "시궁쥐", "생쥐", "땃쥐", "두더지", "들쥐",
    "흰넓적다리붉은쥐", "등줄쥐", "독일바퀴", "미국바퀴", "먹바퀴", "일본바퀴", "경도바퀴", "산바퀴", "애집개미",
    "침개미", "유령개미", "미친개미", "미동정개미", "외곽개미", "쌀바구미", "팥바구미", "거짓쌀도둑거저리",
    "톱가슴머리대장", "장두", "애알락수시렁이", "애수시렁이", "암검은수시렁이", "권연벌레", "거저리", "흡혈진드기",
    "쥐며느리", "노래기", "지네", "얼룩점초파리", "집파리", "딸집파리", "나방파리", "초파리", "얼룩무늬등초파리",
    "날파리", "검정날개버섯파리과", "벼룩파리", "큰검정파리", "구리금파리", "쉬파리", "애기똥파리",
    "붉은등우단털파리", "숲모기", "지하집모기", "장구벌레", "깔따구", "깔따구유충", "줄알락명나방",
    "지중해가루명나방", "멸강나방", "해충없음", "딱정벌레", "풍뎅이", "먼지벌레", "메뚜기", "방아깨비", "여치",
    "매미", "털파리", "하늘소", "등에", "꼽등이", "벌", "흰개미", "멸구", "각다귀", "사면발이", "톡토기",
    "물자라", "반날개", "풀잠자리", "사슴벌레", "무당벌레", "흡혈해충", "벼룩", "응애", "빈대", "보리나방",
    "그리마", "귀뚜라미", "직물해충", "옷좀나방", "좀벌레", "수목해충", "진딧물", "송충이", "노린재", "목재해충",
    "길앞잡이", "미국선녀벌레", "날도래류", "동굴표본벌레", "방아벌레", "나무좀벌레", "권련침벌", "가루이",
    "매미충", "다듬이벌레(유시충)", "썬더블루 포획", "블루스톰 포획",
]

MIN_SIMILARITY = 0.3


def ngrams(text: Column) -> Column:
    """Lower-case words of two or more characters, and pairs of neighbours."""

    def with_pairs(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - 1)
        pairs = F.transform(places, lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
        return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)

    return let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), with_pairs)


def sum_of_squared_counts(items: Column) -> Column:
    """Sum of squared frequencies of an array's values, inside the row.

    After sorting, a run of length n adds 1 + 3 + … + (2n-1) = n².
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + run * 2 - 1).alias("sum"))

    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["sum"])


def _idf(documents: Column, containing: Column) -> Column:
    return F.ln((documents + 1) / (containing + 1)) + 1


def term_index(terms: DataFrame) -> DataFrame:
    """Grams of the dictionary terms with their weights.

    The corpus of one comparison is the dictionary plus one message, so a gram
    has two weights: without and with the message containing it.
    """
    n = terms.agg(F.count(F.lit(1)) + 1).scalar()
    grams = (
        terms.select("ord", "term", F.explode(ngrams(F.col("term"))).alias("gram"))
        .groupBy("ord", "term", "gram").agg(F.count(F.lit(1)).alias("tf"))
    )
    spread = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = (
        grams.join(spread, "gram")
        .withColumn("idf_absent", _idf(n, F.col("df")))
        .withColumn("idf_present", _idf(n, F.col("df") + 1))
    )
    norms = weighted.groupBy("ord").agg(F.sum(F.pow(F.col("tf") * F.col("idf_absent"), 2)).alias("norm2"))
    return weighted.join(norms, "ord")


def best_term(messages: DataFrame, terms: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Most similar dictionary term of every message, null below ``threshold``.

    ``messages``: id, text.  ``terms``: ord, term; the lower ord wins a tie.
    Only grams that occur in the dictionary leave their message's row: the
    message norm needs the other grams' counts only, and these are summed in
    the row.  Similarities are compared at nine decimals.
    """
    terms = materialise(terms, "terms")
    index = materialise(term_index(terms), "index")
    n = terms.agg(F.count(F.lit(1)) + 1).scalar()
    vocabulary = index.select("gram", "idf_present").distinct()
    grams = messages.select("id", ngrams(F.col("text")).alias("grams")).select(
        "id", "grams", sum_of_squared_counts(F.col("grams")).alias("squares")
    )
    matched = (
        grams.select("id", "squares", F.explode("grams").alias("gram"))
        .join(vocabulary, "gram")
        .groupBy("id", "squares", "gram", "idf_present").agg(F.count(F.lit(1)).alias("c"))
    )
    c2 = F.col("c") * F.col("c")
    per_message = matched.groupBy("id", "squares").agg(
        F.collect_list(F.struct("gram", "c")).alias("found"),
        F.sum(c2).alias("known"),
        F.sum(c2 * F.col("idf_present") * F.col("idf_present")).alias("known2"),
    )
    unknown = F.col("squares") - F.col("known")
    rare = _idf(n, F.lit(1))
    hits = (
        per_message.withColumn("norm2_message", F.col("known2") + unknown * rare * rare)
        .select("id", "squares", "norm2_message", F.explode("found").alias("f"))
        .select("id", "squares", "norm2_message", "f.gram", "f.c")
        .join(index, "gram")
    )
    present2 = F.col("idf_present") * F.col("idf_present")
    scored = hits.groupBy("id", "squares", "norm2_message", "ord", "term", "norm2").agg(
        F.sum(F.col("c") * F.col("tf") * present2).alias("dot"),
        F.sum(F.col("tf") * F.col("tf") * (present2 - F.col("idf_absent") * F.col("idf_absent"))).alias("shift"),
    )
    cosine = F.col("dot") / F.sqrt(F.col("norm2_message") * (F.col("norm2") + F.col("shift")))
    best = (
        scored.withColumn("similarity", F.round(cosine, 9))
        .groupBy("id", "squares")
        .agg(F.max_by(F.struct("term", "similarity"), F.struct("similarity", -F.col("ord"))).alias("b"))
        .where(F.col("b.similarity") >= threshold)
        .select("id", "b.term", "b.similarity")
    )
    return messages.select("id").join(best, "id", "left")


def pieces(text: Column, length: int) -> Column:
    """Distinct substrings of one length; as many as the text has characters at most."""
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(length))))


def contained(needles: DataFrame, texts: DataFrame, least: int, seed: int) -> DataFrame:
    """All pairs ``needle``, ``text`` of which the first, of ``least`` characters or more, is a substring of the second.

    Search by seed and verify: of the pieces of ``seed`` characters of a needle
    the one that the fewest texts have is its seed (a shorter needle is its own).
    Texts are cut into pieces, one per character and length, and meet the
    needles with an equal seed; ``contains`` decides.  A needle with a piece
    that no text has meets none.  Both sides are distinct.
    """
    sizes = range(min(least, seed), seed + 1)
    cut = texts.select("text", F.explode(F.concat(*[pieces(F.col("text"), n) for n in sizes])).alias("piece"))
    long = F.length("needle") >= seed
    own = needles.where(F.length("needle") >= least).select(
        "needle", F.explode(F.when(long, pieces(F.col("needle"), seed)).otherwise(F.array("needle"))).alias("piece")
    )
    had = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(had, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seeds = counted.groupBy("needle").agg(F.min("n").alias("n"), F.min_by("piece", F.struct("n", "piece")).alias("piece")).where("n > 0")
    met = cut.join(materialise(seeds.select("needle", "piece"), "seeds"), "piece")
    return met.where(F.contains("text", F.col("needle"))).select("needle", "text")


MIN_ENTRY, MIN_VALUE = 2, 4
SEED = 4


def _best_partial(values: DataFrame, entries: DataFrame) -> DataFrame:
    distinct = entries.select("entry").where(F.col("entry").isNotNull()).distinct()
    inside = contained(distinct.select(F.col("entry").alias("needle")), values.select(F.col("value").alias("text")), MIN_ENTRY, SEED)
    around = contained(values.select(F.col("value").alias("needle")), distinct.select(F.col("entry").alias("text")), MIN_VALUE, SEED)
    hits = inside.select(F.col("text").alias("value"), F.col("needle").alias("entry")).unionByName(
        around.select(F.col("needle").alias("value"), F.col("text").alias("entry"))
    )
    # The shorter of the two is inside the other.
    scored = hits.join(entries, "entry").withColumn("score", F.least(F.length("entry"), F.length("value")))
    return scored.groupBy("value").agg(F.max_by("label", F.struct("score", -F.col("ord"))).alias("label"))


def longest_match(rows: DataFrame, column: str, first: DataFrame, second: DataFrame, into: str = "label") -> DataFrame:
    """Label of the dictionary entry that fits a name best.

    Tried in order: equal in ``first``, equal in ``second``, best partial in
    ``first``, best partial in ``second``.  Partial: an entry of two or more
    characters inside the name scores its length; a name of four or more
    characters inside an entry scores the name's length; the lower ord wins a
    tie.  Dictionaries: ord, entry, label.  Each distinct name is matched once.
    """
    trimmed = rows.withColumn("value", F.trim(column))
    counted = trimmed.where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("_rows"))
    values, found = counted.select("value"), counted
    steps = [("e1", first), ("e2", second)]
    for name, d in steps:
        found = found.join(d.select(F.col("entry").alias("value"), F.col("label").alias(name)), "value", "left")
    for name, d in [("p1", first), ("p2", second)]:
        found = found.join(_best_partial(values, d).withColumnRenamed("label", name), "value", "left")
    labels = found.select("value", F.coalesce("e1", "e2", "p1", "p2").alias(into), "_rows")
    return join_back(trimmed, materialise(labels, "labels"), ["value"]).drop("value")
