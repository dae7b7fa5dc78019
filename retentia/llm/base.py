"""What the operators of this package share: registry, words, hashes, order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.session import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
# A pandas batch of a text column is cut into pieces of about this many rows.
PIECE = 256


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql.strip()
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under numbered column names, which no operator uses itself, and the new name of each column.

    An operator that passes columns through works on these, so that theirs
    can be of any name.  ``returned`` goes back.
    """
    names = {c: f"column_{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def returned(names: dict[str, str], without: list[str] = (), made: list[str] = ()) -> list[Column]:
    """Columns under their first names but for those left out, then what was made.

    A column of the same name as one that was made gives way to it.
    """
    kept = [F.col(new).alias(old) for old, new in names.items() if old not in without and old not in made]
    return [*kept, *[F.col(c) for c in made]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression that lambdas refer to would otherwise be inlined into them
    and run again for every array element.
    """
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; much faster for pure ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def count_of(text: Column, characters: str) -> Column:
    """Characters of a regular expression's class in a text."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")


def dense_array(values: DataFrame, size: int, default: Column) -> Column:
    """Values by ``key`` from 0 to ``size`` - 1 as one array, a scalar subquery.

    ``values`` has a ``value`` for some of the keys; the others get ``default``.
    The size is fixed, so the array fits wherever it is sent.
    """
    keys = values.sparkSession.range(size).select(F.col("id").alias("key"))
    filled = keys.join(values, "key", "left").select("key", F.coalesce("value", default).alias("value"))
    rows = filled.agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("rows"))
    return rows.select(F.transform("rows", lambda x: x["value"])).scalar()


def part_of(values: Column, start: Column, size: Column) -> Column:
    """``size`` elements from ``start``, which counts from 0.

    ``slice`` copies the whole array each time, so it is not for every element of a long one.
    """
    places = F.sequence(start, start + size - 1)
    return F.when(size < 1, F.slice(values, 1, 0)).otherwise(F.transform(places, lambda i: F.get(values, i)))


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % divisor, F.lit(-1))


def bounded_sample(rows: DataFrame, key: list[str], most: int, seed: int) -> DataFrame:
    """About ``most`` rows, chosen by a seeded hash; all of them if there are fewer.

    The share follows from one count.  Equal keys go in or out together.
    """
    total = rows.count()
    if total <= most:
        return rows
    limit = int(2**63 * (most / total))
    return rows.where((F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)) < limit)


def pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), PIECE):
        yield frame.iloc[start : start + PIECE]


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions, written out, with ``_part`` as their number.

    Reading ``_part`` back from the table keeps it the same in every later use.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    return materialise(ranged.withColumn("_part", F.spark_partition_id()), "ordered")


def numbered(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """Position of each row in ascending order, from 0; ``order`` is unique.

    Rows are ranked within range partitions; only the partitions' row counts
    meet in one place.
    """
    placed = in_order(rows, order)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))  # one row per partition
    within = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = placed.join(offsets, "_part").withColumn(into, F.row_number().over(within) - 1 + F.col("_start"))
    return ranked.drop("_part", "_start")


# A key that holds more than this share of all rows is broadcast; there are fewer than one over it.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, stats: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the other columns of ``stats``, which has at most one row per key; null keys are equal.

    ``stats`` is a written table in which ``count`` is the number of the key's
    rows, null or more.  Rows of keys that hold over a thousandth of all rows, of
    which there are fewer than a thousand, meet a broadcast of those; the
    others are joined by key.  Rows are read twice and should be written too.
    """
    values = [c for c in stats.columns if c not in (*keys, count)]
    total = stats.agg(F.sum(count)).first()[0] or 0
    named = stats.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *values, count)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    is_hot = F.coalesce(F.col(count) > total * HOT_SHARE, F.lit(False))
    hot = F.broadcast(named.where(is_hot))  # fewer than 1 / HOT_SHARE rows
    spread = rows.join(hot, same).select(*rows.columns, *values)
    rest = rows.join(hot, same, "left_anti").join(named.where(~is_hot), same, "left").select(*rows.columns, *values)
    return spread.unionByName(rest)
