"""Language identification, words first with back-off to character n-grams.

A word that the model knows in some language is scored by the logarithm of its
relative frequency in each.  A word that it does not know is scored by its
n-grams of the greatest length of which any is known, down to single letters.
A text's score for a language is the mean over its words (Jauhiainen et al.,
"HeLI, a word-based backoff method for language identification", 2016).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.base import pieces, renamed, returned

UNKNOWN = "und"
# Bounds of the model: documents fitted per language, entries kept per language
# and length.  With L languages the model has at most L * (WORDS + GRAMS * ORDER)
# entries.
FIT_DOCUMENTS = 5_000
WORDS = 20_000
GRAMS = 4_000
ORDER = 5
# Logarithm for an entry that a language lacks, below that of its rarest one.
MARGIN = 0.5
CACHE = 200_000
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
_SPARK_LETTERS = "[^\\p{L}]+"


def fit(
    rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "text", documents: int = FIT_DOCUMENTS, words: int = WORDS,
    grams: int = GRAMS, order: int = ORDER, seed: int = 3,
) -> DataFrame:
    """Model entries: ``lang``, ``size`` (0 for a word, else n), ``gram``, ``logp``.

    Fitted on a sample of about ``documents`` texts per language, chosen by a
    seeded hash of ``key`` and the text; all of a language with fewer.  The ``words``
    commonest words and the ``grams`` commonest n-grams of each length are
    kept, ties by code point.  Rows with a null text or language are left out.
    """
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    share = known.groupBy("lang").agg((F.lit(float(documents)) / F.count(F.lit(1))).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "text"), 11) / F.lit(float(2**53))
    sample = known.join(F.broadcast(share), "lang").where(place < F.col("share"))  # a row per language
    found = sample.select("lang", F.explode(F.split(F.lower("text"), _SPARK_LETTERS)).alias("gram")).where("gram <> ''")
    counts = found.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))

    def cut(size: int) -> Column:
        places = F.sequence(F.lit(1), F.length(padded) - size + 1)
        made = F.transform(places, lambda i: F.struct(F.lit(size).alias("size"), F.substring(padded, i, F.lit(size)).alias("gram")))
        return F.when(F.length(padded) >= size, made).otherwise(F.slice(made, 1, 0))

    cuts = [cut(size) for size in range(1, order + 1)]
    whole = F.array(F.struct(F.lit(0).alias("size"), F.col("gram").alias("gram")))
    entries = (
        counts.select("lang", "n", F.explode(F.concat(whole, *cuts)).alias("e"))
        .select("lang", "n", "e.size", "e.gram")
        .where("trim(gram) <> ''")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = entries.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    commonest = Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "gram")
    kept = entries.withColumn("rank", F.row_number().over(commonest)).where(
        F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(grams)
    )
    return kept.join(F.broadcast(totals), ["lang", "size"]).select(  # a row per language and length
        "lang", "size", "gram", F.log(F.col("n") / F.col("total")).alias("logp")
    )


class Model:
    """Scores of words per language; languages are in code point order."""

    def __init__(self, entries: pd.DataFrame) -> None:
        self.langs = sorted(set(entries["lang"]))
        place = {name: i for i, name in enumerate(self.langs)}
        self.order = int(entries["size"].max()) if len(entries) else 0
        self.tables: list[dict[str, int]] = [{} for _ in range(self.order + 1)]
        rows = [self.tables[s].setdefault(g, sum(map(len, self.tables))) for s, g in zip(entries["size"], entries["gram"], strict=True)]
        least = entries["logp"].min() - MARGIN if len(entries) else 0.0
        # The last row is for words without a known letter.
        self.scores = np.full((max(rows, default=-1) + 2, len(self.langs)), least, np.float32)
        self.scores[rows, [place[x] for x in entries["lang"]]] = entries["logp"]
        self.seen: dict[str, int] = {}
        self.found = np.empty((1024, len(self.langs)), np.float32)

    def word(self, word: str) -> np.ndarray:
        row = self.tables[0].get(word) if self.tables else None
        if row is not None:
            return self.scores[row]
        padded = f" {word} "
        for size in range(min(self.order, len(padded)), 0, -1):
            table = self.tables[size]
            known = [table[g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in table]
            if known:
                return self.scores[known].mean(axis=0)
        return self.scores[-1]

    def _place(self, word: str) -> int:
        """Row of a word in ``found``, scored on its first use."""
        place = self.seen.get(word)
        if place is None:
            place = self.seen[word] = len(self.seen)
            if place == len(self.found):
                self.found = np.concatenate([self.found, np.empty_like(self.found)])
            self.found[place] = self.word(word)
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; the score is its share against the others, from 0 to 1."""
        words = _WORDS.findall(text.lower()) if text else []
        if not self.langs or not (any(map(str.isalpha, words)) or _LETTER.search(text or "")):
            return UNKNOWN, 0.0
        if len(self.seen) >= CACHE:
            self.seen.clear()
        places = np.fromiter(map(self._place, words), np.int64, len(words))
        mean = self.found[places].mean(axis=0, dtype=np.float64)
        best = int(np.argmax(mean))
        return self.langs[best], float(1.0 / np.exp(mean - mean[best]).sum())


def predict(rows: DataFrame, model: pd.DataFrame, text: str = "text", prefix: str = "lang") -> DataFrame:
    """The rows without ``text``, with ``<prefix>_pred`` and ``score``.

    A null text and a text without a letter get ``und`` and score 0, as does
    every text if the model has no language.  Equal scores: the first language
    by code point.  The whole text counts; batches are worked through a few
    rows at a time.  Other columns stay, but for those of the new names.
    """
    rows, names = renamed(rows)
    kept = [c for old, c in names.items() if old != text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    shared = rows.sparkSession.sparkContext.broadcast(Model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value  # one per worker process, with the words it has seen
        for batch in batches:
            for part in pieces(batch):
                found = [own.predict(x) for x in part["_text"]]
                columns = {f"{prefix}_pred": [x[0] for x in found], "score": [x[1] for x in found]}
                yield part[kept].assign(**columns)

    picked = rows.select(*kept, F.col(names[text]).alias("_text"))
    found = picked.mapInPandas(run, f"{schema + ', ' if schema else ''}{prefix}_pred string, score double")
    return found.select(*returned(names, [text], [f"{prefix}_pred", "score"]))


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", key: str = "text", **bounds: int) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by a model of ``training``.

    The model is collected; its size is bounded by the parameters of ``fit``.
    """
    return predict(docs, fit(training, text, lang, key, **bounds).toPandas(), text)
