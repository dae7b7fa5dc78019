"""The training-data pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import decontam, langid, mixing, packing, simhash
from retentia.llm.base import id_remainder, renamed, returned, table
from retentia.llm.queries import END_ID, TOKENIZER, VOCABULARY
from retentia.session import bound_batches, materialise, scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and texts without a letter.

    ``lang`` is filled in where it is null.
    """
    bound_batches(spark)
    rows, names = renamed(docs)
    key, text, lang = (names[c] for c in ("doc_id", "text", "lang"))
    training = rows.where(id_remainder(key, 5) != 0)
    model = langid.fit(training, text=text, lang=lang, key=key).toPandas()
    columns = rows.withColumn("_text", F.col(text))
    found = langid.predict(columns, model, "_text").where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*returned(names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked fingerprints.

    Fingerprints of three-word shingles that differ in at most three bits are
    linked, as in ``op1_simhash``.  Of rows that repeat an id one stays, the
    smallest by fingerprint and text hash.  Groups without any id keep one row
    as well.
    """
    bound_batches(spark)
    rows, names = renamed(docs)
    key, text = names["doc_id"], names["text"]
    place = F.xxhash64(key, text)
    groups = simhash.near_duplicates(rows.select(key, text, place.alias("_place")), key, text, keep=["_place"])
    places = groups.groupBy("root", "_place").agg(
        F.min(F.struct(F.col(key).isNull(), key, "fingerprint")).alias("b"), F.count(F.lit(1)).alias("n")
    )
    best = places.groupBy("root").agg(F.min(F.struct("b", "_place", "n")).alias("c"))
    chosen = materialise(best.groupBy(F.col("c._place").alias("_place")).agg(F.sum("c.n").alias("_rows")), "chosen")
    # The texts are hashed past the chosen places, a number each, and not sorted; only repeated rows are.
    kept = rows.withColumn("_place", place).join(chosen.hint("shuffle_hash"), "_place")
    single, several = kept.where("_rows = 1"), kept.where("_rows > 1").dropDuplicates(["_place"])
    return single.unionByName(several).select(*returned(names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a benchmark window."""
    found = decontam.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = materialise(found.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
    rows, names = renamed(docs)
    same = F.col(names["doc_id"]).eqNullSafe(F.col("_bad_id")) & F.xxhash64(names["text"]).eqNullSafe(F.col("_bad_hash"))
    return rows.join(bad, same, "left_anti").select(*returned(names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, read back."""
    bound_batches(spark)
    encoder = packing.word_encoder(public_tokenizers.path(TOKENIZER), END_ID)
    return packing.read(packing.write(docs.select("doc_id", "text"), scratch_dir(spark, "tokens"), encoder, VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("pack_tokens", pack_tokens),
]

# Language scores, hashes and token ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
