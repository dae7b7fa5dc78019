"""Line deduplication by overlapping windows of three lines.

The lines of a text, without white space at their ends, are hashed in
overlapping windows of three; a shorter text is one window.  A window that occurs more than once in the
corpus keeps its first occurrence; the lines that later ones cover go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import SPACE, let, renamed, returned
from retentia.session import materialise

WINDOW = 3


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def _marked(lines: Column, size: int) -> Column:
    """Windows with a word, ordered by hash: ``h``, ``g``, ``pos`` and whether the text had it before."""

    def window(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(size)]
        word = F.lit(False)
        for line in part:  # a text of fewer lines has nulls for those it lacks
            word = word | F.coalesce(line != "", F.lit(False))
        return F.struct(F.xxhash64(*part).alias("h"), F.xxhash64(F.lit(1), *part).alias("g"), i.alias("pos"), word.alias("word"))

    def again(rows: Column) -> Column:
        def mark(x: Column, j: Column) -> Column:
            before = F.get(rows, j - 1)
            same = F.coalesce((before["h"] == x["h"]) & (before["g"] == x["g"]), F.lit(False))
            return F.struct(x["h"].alias("h"), x["g"].alias("g"), x["pos"].alias("pos"), same.alias("again"))

        return F.transform(rows, mark)

    last = F.greatest(F.size(lines) - size, F.lit(0))
    made = F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda x: x["word"])
    return let(F.array_sort(made), again)


def windows(docs: DataFrame, doc_id: str, text: str, size: int = WINDOW) -> DataFrame:
    marked = let(_trimmed(F.col(text)), lambda t: _marked(t, size))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(marked).alias("w")
    )
    return rows.select("doc_id", "text_hash", "w.*")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the cleaned ``text``, and ``n_lines``, ``n_removed``.

    Occurrences are ordered by document id, null last, then position.  All
    lines that any later occurrence covers are removed, overlapping covers
    merged; every removed line has an equal line before it that stays.  Windows
    of blank lines don't count, and a text with fewer than ``size`` lines is one
    window, which equals none of a longer text.  Rows that share an id count as one document: a window keeps all its
    first occurrences in them.  A null text stays null with no lines; an empty
    text is one line.  Other columns stay as they are.

    Documents are counted per window with partial sums before the shuffle; only
    windows of two or more documents are joined back, from a written table, so
    that the skew rule can split a window that very many documents have.
    """
    docs, names = renamed(docs)
    doc_id, text_name, text = names[doc_id], text, names[text]
    found = windows(docs, doc_id, text, size)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    seen = found.where("NOT again").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    repeated = materialise(seen.where("n > 1").select("h", "g", "first"), "repeated")
    later = found.where("NOT again").join(repeated, ["h", "g"]).where(order > F.col("first")).select("doc_id", "text_hash", "pos")
    inside = found.where("again").select("doc_id", "text_hash", "pos")
    spans = later.unionByName(inside).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_starts"))
    spans = materialise(spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_starts"), "spans")
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    # Texts move once at every size, whether or not the spans would fit a broadcast.
    joined = docs.join(spans.hint("merge"), same, "left")

    def clean(lines: Column) -> Column:
        covered = F.flatten(F.transform("_starts", lambda p: F.sequence(p, p + size - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        text_ = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
        return F.struct(text_.alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))

    cleaned = F.when(F.col("_starts").isNotNull() & F.col(text).isNotNull(), let(F.split(text, "\n"), clean))
    others = [c for c in docs.columns if c != text]
    rows = joined.select(*others, F.col(text).alias("_text"), cleaned.alias("_clean"))
    made = rows.select(
        *others,
        F.coalesce("_clean.text", "_text").alias(text),
        F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_clean.removed", F.lit(0)).cast("long").alias("n_removed"),
    )
    return made.select(*returned(names, made=[c for c in ("n_lines", "n_removed") if c != text_name]))
