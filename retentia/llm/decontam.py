"""Benchmark decontamination with a positional inverted index.

The index holds postings of the corpus: term, document, position, and the terms
up to a window's length to either side, all as 64-bit hashes.  Only terms that
a query asks for first are stored.  A query is a run of terms; its rarest term
(by count over the whole corpus) is looked up in the index, which gives the
place where the run would have to begin, and the lists of its other terms are
intersected there, shifted by their offsets, rarest first.  The neighbours in
the posting answer that without another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import ascii_lower, dense_array, let, part_of
from retentia.session import materialise

WINDOW = 13
# The filter on probe terms: 64-bit words of a bitmap that is sent to all tasks.
BITMAP = 1 << 16


def _split(text: Column) -> Column:
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def terms(text: Column) -> Column:
    """Hashes of the lower-cased words; none for a null text."""
    return F.transform(_split(text), lambda w: F.xxhash64(w))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``item`` and the distinct ``window``s of its terms; a shorter item is one window."""
    none = F.array().cast("array<array<bigint>>")
    cut = let(
        terms(F.col(text)),
        lambda t: F.when(F.size(t) == 0, none).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1))), lambda i: part_of(t, i - 1, F.least(F.size(t), F.lit(size))))
        ),
    )
    return items.select(F.col(item_id).cast("string").alias("item"), F.explode(cut).alias("window")).distinct()


def _bitmap(chosen: DataFrame) -> Column:
    """Bitmap of the hashes in ``term`` as an array of a fixed number of words."""
    words = chosen.select(F.pmod(F.shiftright("term", 6), F.lit(BITMAP)).alias("word"), F.pmod("term", F.lit(64)).alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
    full = words.distinct().groupBy(F.col("word").alias("key")).agg(F.bit_or(bit).alias("value"))
    return dense_array(full, BITMAP, F.lit(0).cast("long"))


def _in(bitmap: Column, term: Column) -> Column:
    word = F.get(bitmap, F.pmod(F.shiftright(term, 6), F.lit(BITMAP)).cast("int"))
    return F.getbit(word, F.pmod(term, F.lit(64)).cast("int")) == 1


def corpus_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """``term`` and ``n``, its count in all documents, of each term of ``vocabulary``."""
    found = docs.select(F.explode(_split(F.col(text))).alias("word")).select(F.xxhash64("word").alias("term"))
    kept = found.where(_in(_bitmap(vocabulary), F.col("term")))
    counts = kept.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def probes(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct windows with their rarest ``term`` and its first ``offset``.

    Windows with a term that the corpus lacks are left out: they occur nowhere.
    Of equally rare terms the smallest hash is taken.
    """
    distinct = wanted.select("window").distinct().withColumn("window_id", F.xxhash64("window"))
    each = distinct.select("window_id", "window", F.explode(F.array_distinct("window")).alias("term")).join(counts, "term")
    rarest = each.groupBy("window_id").agg(
        F.min("n").alias("least"), F.min(F.struct("n", "term"))["term"].alias("term"), F.first("window").alias("window")
    )
    return rarest.where("least > 0").select(
        "window_id", "window", "term", (F.array_position("window", F.col("term")) - 1).cast("int").alias("offset")
    )


def build_index(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = WINDOW - 1) -> DataFrame:
    """The index, written to the shared folder: a row per document with its postings.

    ``doc_id``, ``text_hash`` (the two name a document; rows that agree in both
    have equal results), ``n_words`` and ``postings`` of the terms in
    ``chosen``: term, position from 0, number of terms before it that follow
    in ``around``, and ``around``, the terms up to ``reach`` to either side.
    """
    # A subquery can't stand in a lambda; as a column it gets there.
    bitmap = F.col("_bitmap")

    def posting(t: Column, x: Column) -> Column:
        lead = F.least(x["pos"], F.lit(reach))
        around = part_of(t, x["pos"] - lead, F.least(lead + reach + 1, F.size(t) - x["pos"] + lead))
        return F.struct(x["term"].alias("term"), x["pos"].alias("pos"), lead.alias("lead"), around.alias("around"))

    def row(t: Column) -> Column:
        placed = F.transform(t, lambda x, i: F.struct(x.alias("term"), i.alias("pos")))
        kept = F.filter(placed, lambda x: _in(bitmap, x["term"]))
        return F.struct(F.size(t).cast("long").alias("n_words"), F.transform(kept, lambda x: posting(t, x)).alias("postings"))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), _bitmap(chosen).alias("_bitmap"))
    made = rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), let(terms(F.col("_text")), row).alias("r"))
    return materialise(made.select("doc_id", "text_hash", "r.*"), "index")


def matches(index: DataFrame, wanted: DataFrame, slack: int = 0) -> DataFrame:
    """Where windows occur: ``doc_id``, ``text_hash``, ``window_id``, ``start``, ``size``, ``exact``.

    With ``slack`` over 0, proximity matches follow: every term occurs at most
    that many places from where the phrase would have it; the index needs a
    reach that much greater.  ``start`` can then be below 0.
    """
    postings = index.where(F.size("postings") > 0).select("doc_id", "text_hash", F.explode("postings").alias("p"))
    postings = postings.select("doc_id", "text_hash", "p.*")
    met = postings.join(wanted, "term").withColumn("size", F.size("window"))
    # The first of the window's places in the list of terms around, from 1.
    first = F.col("lead") - F.col("offset") + 1
    exact = F.when(first >= 1, F.slice("around", first, F.col("size")) == F.col("window")).otherwise(False)
    if not slack:
        met = met.where(exact).withColumn("exact", F.lit(True))
    else:
        met = met.withColumn("first", first).withColumn("exact", exact)
        met = met.where(F.col("exact") | _near(slack))
    return met.select("doc_id", "text_hash", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "size", "exact")


def _near(slack: int) -> Column:
    def close(term: Column, i: Column) -> Column:
        at = F.col("first") + i
        low = F.greatest(at - slack, F.lit(1))
        return (at + slack >= 1) & F.array_contains(F.slice("around", low, F.greatest(at + slack - low + 1, F.lit(0))), term)

    return F.forall(F.transform("window", close), lambda x: x)


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    size: int = WINDOW, share: int = 20,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``text_hash``.

    A word is hit if it lies in any occurrence of a window; a document is
    contaminated if at least one word in ``share`` is hit.  Null and empty
    texts have no words and are clean; items without words have no window;
    items with a null id hit words but are not listed.  Repeated rows count
    each.  Other columns are ignored.  Without items or without documents every
    row is clean or there is none.
    """
    wanted = materialise(windows(items, item_id, "text", size), "windows")
    vocabulary = wanted.select(F.explode("window").alias("term")).distinct()
    counts = materialise(corpus_counts(docs, materialise(vocabulary, "vocabulary"), text), "counts")
    chosen = materialise(probes(wanted, counts), "probes")
    index = build_index(docs, chosen.select("term"), doc_id, text, size - 1)
    found = materialise(matches(index, chosen), "matches")
    name = ["doc_id", "text_hash"]
    spans = F.sort_array(F.collect_set(F.struct("start", "size")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(done: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        more = F.greatest(end - F.greatest(done["end"], span["start"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["n"] + more).alias("n"))

    hits = found.groupBy(*name).agg(spans.alias("spans")).select(*name, F.aggregate("spans", start, cover)["n"].alias("n_hit"))
    in_items = wanted.select("item", F.xxhash64("window").alias("window_id"))
    listed = (
        found.select(*name, "window_id").distinct().join(materialise(in_items, "items"), "window_id")
        .groupBy(*name).agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    per_text = hits.join(listed, _same(hits, listed, name), "left").select(hits["doc_id"], hits["text_hash"], "n_hit", "items")
    rows = index.select("doc_id", "text_hash", "n_words").alias("d")
    results = materialise(per_text, "results").alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("r.text_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(results, same, "left").select(
        F.col("d.doc_id").alias(doc_id),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("d.text_hash").alias("text_hash"),
    )


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out
