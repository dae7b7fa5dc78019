"""From a model's answer to the stored five-slot classification."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.arrays import let
from retentia.functions.dates import kst_to_utc
from retentia.functions.text import clean_for_model, is_claim, keywords_in_text, model_answer
from retentia.operators.taxonomy import OTHER, resolve_chain

SLOTS = 5
BATCH = 8
MODEL_NAME, MODEL_VERSION = "voc-classifier", "1.0"

# A scorer takes texts and the taxonomy text, and gives one answer text and one
# confidence per input text.
Scorer = Callable[[list[str], str], list[tuple[str | None, float | None]]]


def score_messages(messages: DataFrame, scorer: Scorer, taxonomy_text: str = "", batch: int = BATCH) -> DataFrame:
    """Adds ``answer`` and ``confidence``; a failing batch has no answers.

    ``messages``: id, content.  The scorer runs on the executors, one small
    batch at a time, on the cleaned text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    scored = scorer(part["text"].tolist(), taxonomy_text)
                except Exception:
                    scored = [(None, 0.0)] * len(part)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "answer": [a for a, _ in scored],
                        "confidence": [c for _, c in scored],
                    }
                )

    texts = messages.select("id", clean_for_model(F.col("content")).alias("text"))
    return texts.mapInPandas(run, "id bigint, answer string, confidence double")


def keyword_scorer(rules: dict[str, tuple[str, str, str]], claim_words: list[str]) -> Scorer:
    """Deterministic stand-in for a language model: word → category path."""

    def score(texts: list[str], taxonomy_text: str) -> list[tuple[str, float]]:
        answers = []
        for text in texts:
            words = [w for w in rules if w in text]
            categories = [
                {"major": rules[w][0], "mid": rules[w][1], "minor": rules[w][2], "reason": w} for w in words[:SLOTS]
            ]
            claim = "claim" if any(w in text for w in claim_words) else "non-claim"
            answer = {"is_claim": claim, "summary": text, "keywords": words, "categories": categories}
            answers.append((json.dumps(answer, ensure_ascii=False), min(1.0, len(words) / SLOTS)))
        return answers

    return score


def arrange_slots(slots: Column, other: str = OTHER, compact: bool = False) -> Column:
    """Proper categories first, all-"other" ones next, empty slots last.

    Repeats of a combination become empty in place, or with ``compact`` move
    behind the distinct ones.
    """

    def has_code(s: Column) -> Column:
        return s["main"]["code"].isNotNull() | s["sub"]["code"].isNotNull() | s["detail"]["code"].isNotNull()

    def kind(s: Column) -> Column:
        names = [s["main_name"], s["sub_name"], s["detail_name"]]
        all_other = F.coalesce((names[0] == other) & (names[1] == other) & (names[2] == other), F.lit(False))
        return F.when(~has_code(s), 2).when(all_other, 1).otherwise(0)

    def key(s: Column) -> Column:
        codes = [F.coalesce(s[level]["code"], F.lit("")) for level in ("main", "sub", "detail")]
        return F.concat_ws("\x01", *codes)

    ordered = F.transform(
        F.sort_array(F.transform(slots, lambda s: F.struct(kind(s).alias("kind"), s["pos"].alias("pos"), s.alias("s")))),
        lambda x: x["s"],
    )

    def once(all_slots: Column) -> Column:
        return let(
            F.transform(all_slots, key),
            lambda keys: F.transform(
                all_slots, lambda s, i: F.when(~has_code(s) | (F.array_position(keys, key(s)) == i + 1), s)
            ),
        )

    kept = let(ordered, once)
    if compact:
        kept = F.concat(F.filter(kept, lambda s: s.isNotNull()), F.filter(kept, lambda s: s.isNull()))
    return kept


def category_slots(answers: DataFrame, taxonomy: DataFrame, other: str = OTHER, compact: bool = False) -> DataFrame:
    """Resolved, ordered and deduplicated categories of every message.

    ``answers``: msg_id, categories.  Every message has exactly five slots;
    only filled ones are looked up.
    """
    filled = F.slice("categories", 1, SLOTS)
    slots = answers.select("msg_id", F.posexplode_outer(filled).alias("pos", "c"))
    slots = slots.select("msg_id", F.coalesce("pos", F.lit(0)).alias("pos"), "c.*")
    resolved = resolve_chain(slots, taxonomy, other).withColumns(
        {
            "main_name": F.coalesce("main.name", "major"),
            "sub_name": F.coalesce("sub.name", "mid"),
            "detail_name": F.coalesce("detail.name", "minor"),
        }
    )
    item = F.struct("pos", "main", "main_name", "sub", "sub_name", "detail", "detail_name", "reason")
    grouped = resolved.groupBy("msg_id").agg(F.sort_array(F.collect_list(item)).alias("slots"))
    fields = grouped.schema["slots"].dataType.elementType.fields

    def slot(i: Column) -> Column:
        unused = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name != "pos"]
        return F.coalesce(F.get("slots", i), F.struct(i.alias("pos"), *unused))

    every = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot)
    return grouped.withColumn("slots", every).withColumn("slots", arrange_slots(F.col("slots"), other, compact))


def wide_slots(slots: DataFrame) -> DataFrame:
    """The stored layout: ten columns per slot."""
    columns = [F.col("msg_id")]
    for n in range(1, SLOTS + 1):
        s = F.col("slots")[n - 1]
        for level in ("main", "sub", "detail"):
            columns += [
                s[f"{level}_name"].alias(f"{level}_category_{n}_name"),
                s[level]["id"].alias(f"{level}_category_{n}_id"),
                s[level]["code"].alias(f"{level}_category_{n}_code"),
            ]
        columns.append(s["reason"].alias(f"detail_category_{n}_reason"))
    return slots.select(*columns)


def classified_messages(
    messages: DataFrame,
    scored: DataFrame,
    taxonomy: DataFrame,
    created_at: datetime,
    fallback_term: DataFrame | None = None,
    other: str = OTHER,
) -> DataFrame:
    """The stored classification of every message.

    ``messages``: id, rcno, ccod, received_at (Korean local time), content.
    ``scored``: id, answer, confidence.  ``fallback_term``: id, term — the pest
    found by text similarity, used when the model names none.
    """
    parsed = scored.select(F.col("id").alias("msg_id"), model_answer(F.col("answer")).alias("a"), "confidence")
    slots = wide_slots(category_slots(parsed.select("msg_id", "a.categories"), taxonomy, other))
    rows = messages.select(F.col("id").alias("msg_id"), "rcno", "ccod", "received_at", "content").join(
        parsed, "msg_id", "left"
    )
    bug = F.nullif(F.col("a.bug_type"), F.lit(""))
    if fallback_term is not None:
        rows = rows.join(fallback_term.select(F.col("id").alias("msg_id"), "term"), "msg_id", "left")
        bug = F.coalesce(bug, "term")
    base = rows.select(
        "rcno", "ccod", "msg_id",
        kst_to_utc(F.col("received_at")).alias("msg_received_at"),
        F.lit(created_at).alias("created_at"),
        F.lit(created_at).alias("updated_at"),
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit(MODEL_VERSION).alias("model_ver"),
        "content",
        is_claim(F.col("a.is_claim")).alias("is_claim"),
        F.col("a.summary").alias("summary"),
        F.to_json(keywords_in_text(F.col("a.keywords"), F.col("content"))).alias("keywords"),
        bug.alias("bug_type"),
        F.when(F.col("a").isNull(), 0.0).otherwise(F.col("confidence")).alias("model_confidence"),
    )
    return base.join(slots, "msg_id", "left")
