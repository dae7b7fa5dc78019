"""Fine-tuning examples: load, render, split, write as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.text import prompt
from retentia.operators.groups import join_back
from retentia.operators.sampling import stratified_split
from retentia.session import materialise
from retentia.sources import sinks


def training_examples(rows: DataFrame, instruction: str, held_out: float = 0.1, seed: int = 42) -> DataFrame:
    """Rendered prompt with its answer, and whether the example is held out.

    ``rows``: input_text, category_dict, response.  Copies of an example are on
    the same side.
    """
    rendered = rows.select(
        prompt(F.col("input_text"), F.col("category_dict"), instruction, F.col("response"), training=True).alias("text")
    )
    # Prompts are long; a digest of 256 bits stands for them wherever rows are grouped or joined.
    keyed = rendered.withColumn("_key", F.sha2("text", 256))
    distinct = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).withColumn("all", F.lit(0))
    marked = stratified_split(distinct, "_key", "all", held_out, seed).drop("all")
    return join_back(keyed, materialise(marked, "split"), ["_key"]).drop("_key")


def write_examples(examples: DataFrame, folder: str) -> None:
    for name, mark in (("train", 0), ("validation", 1)):
        sinks.export_json_lines(examples.where(F.col("held_out") == mark).select("text"), f"{folder}/{name}")
