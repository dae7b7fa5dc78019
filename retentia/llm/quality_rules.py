"""Quality rules: counts, and the likelihood of a text as trusted against raw.

Words and pairs of words are hashed into buckets.  Two multinomials over the
buckets are counted: of the trusted texts and of the whole corpus.  A text's
score is the mean over its features of the logarithm of trusted over raw
probability; texts below a threshold are not kept.  (Hashed n-gram importance
as in Xie et al., "Data selection for language models via importance
resampling", 2023, with a fixed threshold in place of sampling.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import count_of, dense_array, let, renamed, returned, words
from retentia.session import materialise

BUCKETS = 1 << 16
THRESHOLD = -0.18
SYMBOLS = "#*$%&|<>"
REPEAT = 5
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]


def features(w: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    firsts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    two = F.transform(firsts, lambda x, i: F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Column:
    """Array of log ratios by bucket, as a scalar subquery of fixed size.

    ``trusted`` holds ids; all their texts form the trusted text and all of
    ``docs`` the raw one.  Counts start at one.
    """
    ids = trusted.select(F.col(doc_id).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    # Texts move once at every size, whether or not the ids would fit a broadcast.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(ids.hint("merge"), F.col("_id") == F.col("_trusted"), "left")
    found = rows.select(F.col("_trusted").isNotNull().cast("long").alias("good"), F.explode(let(words(F.col("_text")), lambda w: features(w, buckets))).alias("bucket"))
    counts = found.groupBy("bucket").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("raw"))
    counts = materialise(counts, "buckets")
    totals = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r")).first()

    def ratio(good: Column, raw: Column) -> Column:
        return F.log(((good + 1) / (totals["g"] + buckets)) / ((raw + 1) / (totals["r"] + buckets)))

    ratios = counts.select(F.col("bucket").alias("key"), ratio(F.col("good"), F.col("raw")).alias("value"))
    return dense_array(ratios, buckets, ratio(F.lit(0), F.lit(0)))


def _repeated(w: Column) -> Column:
    """Words in windows of five that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

        def twice(x: Column, j: Column, rows: Column) -> Column:
            near = [F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False)) for k in (j - 1, j + 1)]
            return near[0] | near[1]

        def add(done: Column, at: Column) -> Column:
            return F.struct((at + REPEAT).alias("end"), (done["n"] + at + REPEAT - F.greatest(done["end"], at)).alias("n"))

        starts = let(placed, lambda rows: F.transform(F.filter(rows, lambda x, j: twice(x, j, rows)), lambda x: x["i"]))
        found = F.aggregate(F.array_sort(starts), start, add)["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - REPEAT), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT)]))
    return F.when(F.size(w) < REPEAT, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def score(docs: DataFrame, ratios: Column, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without ``text``, with the counts, ``base_failed``, ``llr`` and ``kept``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` count whole texts; a null or empty text has zeros and an
    ``llr`` of 0.  ``kept`` is false where a base rule fails, else true if
    ``llr`` is at least ``threshold``.  Repeated rows count each; an empty table
    gives no rows.  Other columns stay, but for those of the new names.
    """
    docs, names = renamed(docs)
    others = [c for old, c in names.items() if old != text]
    rows = docs.select(*others, F.coalesce(F.col(names[text]), F.lit("")).alias("_text"), ratios.alias("_ratios"))

    def row(w: Column) -> Column:
        def total(f: Column) -> Column:
            return F.aggregate(f, F.lit(0.0), lambda s, k: s + F.get(F.col("_ratios"), k)) / F.greatest(F.size(f), F.lit(1))

        return F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"),
            let(features(w, buckets), total).alias("llr"),
        )

    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    made = rows.select(
        *others,
        let(words(F.col("_text")), row).alias("r"),
        (F.length("_text") - count_of(F.col("_text"), " \\t-\\r")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    )
    found = made.select(*others, "r.n_words", "word_chars", "n_symbols", "n_dup_lines", "r.n_repeat_words", "r.llr")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return judged.select(*returned(names, [text], MADE))


def assess(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return score(docs, fit(docs, trusted, doc_id, text), text, **options)
