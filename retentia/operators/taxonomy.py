"""Three-level taxonomy: tree, and lookups that fall back to "other"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.text import canonical_category
from retentia.operators.groups import Children, nest

OTHER = "기타"


def load_taxonomy(raw: DataFrame) -> DataFrame:
    """Levels arrive as decimals; empty parents as empty text."""
    return raw.select(
        F.col("voc_id"),
        F.col("name"),
        F.nullif(F.trim("parent_id"), F.lit("")).alias("parent_id"),
        F.col("level").cast("double").cast("int").alias("level"),
    )


def _level(taxonomy: DataFrame, n: int) -> DataFrame:
    return taxonomy.where(F.col("level") == n)


def taxonomy_tree(taxonomy: DataFrame, max_items: int = 100_000) -> DataFrame:
    """One row per main and sub category with the sorted detail names."""
    main = _level(taxonomy, 1).select(F.col("voc_id").alias("main_code"), F.col("name").alias("main_name"))
    sub = _level(taxonomy, 2).select(
        F.col("parent_id").alias("main_code"), F.col("voc_id").alias("sub_code"), F.col("name").alias("sub_name")
    )
    detail = _level(taxonomy, 3).select(
        F.col("parent_id").alias("sub_code"), F.col("voc_id").alias("code"), F.col("name")
    )
    names = Children(detail, "details", ["code", "name"], ["code"])
    return nest(main.join(sub, "main_code"), ["sub_code"], [names], max_items)


def taxonomy_json(taxonomy: DataFrame) -> str:
    """The whole tree as the JSON text a prompt carries.

    It is one text, so it goes through one task and the driver; how long a
    prompt may be is up to the scorer.
    """
    sub = F.struct("sub_code", "sub_name", F.col("details.name").alias("names"))
    mains = taxonomy_tree(taxonomy).groupBy("main_code", "main_name").agg(F.sort_array(F.collect_list(sub)).alias("subs"))
    whole = mains.agg(F.sort_array(F.collect_list(F.struct("main_code", "main_name", "subs"))).alias("mains"))

    def by_name(subs: Column) -> Column:
        return F.map_from_entries(F.transform(subs, lambda s: F.struct(s["sub_name"], s["names"])))

    tree = F.map_from_entries(F.transform("mains", lambda m: F.struct(m["main_name"], by_name(m["subs"]))))
    return whole.select(F.to_json(tree).alias("json")).first()["json"]


def _entry() -> Column:
    return F.struct("id", F.col("voc_id").alias("code"), "name")


def resolve_level(
    rows: DataFrame,
    taxonomy: DataFrame,
    level: int,
    name: str,
    into: str,
    parent: str | None,
    other: str = OTHER,
) -> DataFrame:
    """Taxonomy entry of a name below its resolved parent.

    Tried in order: the name, the parent's own "other" entry, the level-wide
    "other" entry.  No name or no parent gives null.  The entry with the
    smallest id wins among equals.
    """
    entries = _level(taxonomy, level)
    keys = ["_name"] if parent is None else ["_parent", "_name"]
    named = entries.select(
        F.col("name").alias("_name"), F.col("parent_id").alias("_parent"), _entry().alias("_entry")
    )
    exact = named.groupBy(*keys).agg(F.min("_entry").alias("_exact"))
    wide = named.where(F.col("_name") == other).agg(F.min("_entry")).scalar()

    usable = F.col(name).isNotNull() & (F.col(name) != "")
    rows = rows.withColumn("_name", canonical_category(F.col(name)))
    if parent is None:
        rows = rows.join(exact, "_name", "left")
        found = F.coalesce("_exact", wide)
    else:
        usable = usable & F.col(parent).isNotNull()
        own_other = exact.where(F.col("_name") == other).select("_parent", F.col("_exact").alias("_own_other"))
        rows = (
            rows.withColumn("_parent", F.col(parent))
            .join(exact, ["_parent", "_name"], "left")
            .join(own_other, "_parent", "left")
        )
        found = F.coalesce("_exact", "_own_other", wide)
    return rows.withColumn(into, F.when(usable, found)).drop("_name", "_parent", "_exact", "_own_other")


def resolve_chain(rows: DataFrame, taxonomy: DataFrame, other: str = OTHER) -> DataFrame:
    """Main, sub and detail entry for the columns major, mid and minor."""
    rows = resolve_level(rows, taxonomy, 1, "major", "main", None, other)
    rows = resolve_level(rows, taxonomy, 2, "mid", "sub", "main.code", other)
    return resolve_level(rows, taxonomy, 3, "minor", "detail", "sub.code", other)


def code_name(rows: DataFrame, codes: DataFrame, column: str, into: str, default: str = "Unknown") -> DataFrame:
    """Name of a code, ``default`` when the dictionary lacks it."""
    names = codes.select(F.col("code").alias(column), F.col("name").alias("_name"))
    return rows.join(names, column, "left").withColumn(into, F.coalesce("_name", F.lit(default))).drop("_name")
