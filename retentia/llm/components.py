"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.session import materialise


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches.

    ``links`` has columns ``a`` and ``b`` of one orderable type.  Nodes without
    a link to another node are left out.  Links may repeat and come in either
    direction; nulls are ignored.  No links give no rows.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest of all.  Minima are combined map-side and joined back from a
    written table, so a hub with very many links is split by the skew rule.
    Every round starts from a written table.  Raises if ``rounds`` don't do.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    for _ in range(rounds):
        if _is_star(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        edges = materialise(_small_star(materialise(_large_star(edges), "large")), "small")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _is_star(edges: DataFrame) -> bool:
    """Each node has one smaller neighbour, which has none itself."""
    repeated = edges.groupBy("u").count().where("count > 1")
    inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return repeated.isEmpty() and inner.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return larger.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(kept).distinct()
