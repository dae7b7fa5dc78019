"""Building blocks that stay whole and distributed when one key is huge.

* ``with_group_stats`` brings aggregates of a key back to its rows, and
  ``next_value`` is ``lead`` over an order column.  Neither uses a window over
  rows, which would put a whole key into one task: aggregates are combined
  map-side, and ``join_back`` joins them to the rows without gathering the rows
  of a hot key.  (The run-time skew rule does not split a join whose other side
  is an aggregate.)
* ``pack`` and ``nest`` collect children in parts of bounded size.
* ``top_per_group`` is a rank filter, which Spark cuts to k rows per task and
  group before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.session import materialise

MAX_ITEMS = 100_000
# Bound on the number of hot keys, rows that make a key hot, and the number of
# pieces a hot key is spread over.
HOT_KEYS = 200_000
HOT_ROWS = 10_000_000
SALTS = 4_096


def _row_hash(columns: list[str]) -> Column:
    """Hash that also tells copies of a row in different input partitions apart.

    A repeated task gives the same values, whatever order it reads its rows in.
    """
    return F.xxhash64(*columns, F.spark_partition_id())


def join_back(rows: DataFrame, stats: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """Left join of one-row-per-key ``stats`` to the rows they describe.

    ``stats`` is materialised and counts the key's rows in ``_rows``.  Without
    hot keys this is one join on the key, whose partitioning later groupings
    by the key reuse.  Hot keys are broadcast: a key is hot when it has more
    than a fixed number of rows and more than 1 / HOT_KEYS of them all, so
    there are fewer than HOT_KEYS.  Their rows are spread by hash
    through the second join, where they find nothing.
    """
    values = [c for c in stats.columns if c not in (*keys, "_rows")]
    total = stats.agg(F.sum("_rows")).first()[0] or 0
    hot = stats.where(F.col("_rows") > max(hot_rows or HOT_ROWS, total // HOT_KEYS))
    if hot.isEmpty():
        return rows.join(stats.drop("_rows"), keys, "left")
    hot_side = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_is_hot"))
    spread = F.when(F.col("_is_hot"), F.pmod(_row_hash(rows.columns), F.lit(SALTS)) + 1).otherwise(0)
    cold = stats.drop("_rows").withColumn("_salt", F.lit(0).cast("bigint"))
    joined = (
        rows.join(F.broadcast(hot_side), keys, "left")
        .withColumn("_salt", spread.cast("bigint"))
        .join(cold, [*keys, "_salt"], "left")
    )
    picked = [F.when(F.col("_is_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*rows.columns, *picked)


def with_group_stats(rows: DataFrame, keys: list[str], hot_rows: int | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of the row's group as new columns."""
    columns = [c.alias(n) for n, c in aggregates.items()]
    stats = materialise(rows.groupBy(*keys).agg(*columns, F.count(F.lit(1)).alias("_rows")), "stats")
    return join_back(rows, stats, keys, hot_rows)


def next_value(
    rows: DataFrame, keys: list[str], order: str, tie: str, into: str, hot_rows: int | None = None
) -> DataFrame:
    """Value of ``order`` in the following row of the group.

    Rows are ordered by ``order`` (nulls last), then ``tie``.  Within equal
    order values every row but the last sees that same value; the last one sees
    the next distinct value.  Rows with a null key have no group and get null.
    ``tie`` tells the rows of a group apart.  The window sees the distinct
    order values of a key, not its rows.
    """
    steps = (
        rows.where(F.col(order).isNotNull())
        .dropna(subset=keys)
        .groupBy(*keys, order)
        .agg(F.max(tie).alias("_last_tie"), F.count(F.lit(1)).alias("_rows"))
    )
    ordered = Window.partitionBy(*keys).orderBy(order)
    steps = steps.withColumn("_next", F.lead(order).over(ordered)).withColumn("_found", F.lit(True))
    joined = join_back(rows, materialise(steps, "steps"), [*keys, order], hot_rows)
    follows = F.when(F.col(tie).eqNullSafe(F.col("_last_tie")), F.col("_next")).otherwise(F.col(order))
    return joined.withColumn(into, F.when(F.col("_found"), follows)).drop("_last_tie", "_next", "_found")


@dataclass(frozen=True)
class Children:
    """Rows to become one array per parent: which columns, in which order.

    ``weight`` is what a row counts towards the size limit, one by default.
    """

    rows: DataFrame
    into: str
    element: list[str]
    order: list[str]
    weight: Column | None = None


def _hot_keys(children: list[Children], keys: list[str], max_items: int) -> DataFrame | None:
    """Keys too big for one row and the number of parts they need, if any.

    There are at most total / max_items of them.
    """
    sizes = None
    for child in children:
        size = F.sum(child.weight if child.weight is not None else F.lit(1))
        big = child.rows.groupBy(*keys).agg(F.ceil(size / max_items).cast("int").alias("_parts")).where("_parts > 1")
        sizes = big if sizes is None else sizes.unionByName(big)
    hot = materialise(sizes.groupBy(*keys).agg(F.max("_parts").alias("_parts")), "hot")
    return None if hot.isEmpty() else hot


def _with_parts(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``_parts`` of the hot keys, joined without gathering a key's rows."""
    salted = rows.withColumn("_salt", F.pmod(_row_hash(rows.columns), F.lit(64)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))
    copies = hot.withColumn("_salt", F.explode(every))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def _pack(child: Children, keys: list[str], hot: DataFrame | None) -> DataFrame:
    fields = list(dict.fromkeys([*child.order, *child.element]))
    rows = child.rows
    if hot is None:
        rows = rows.withColumn("part", F.lit(0))
    else:
        cut = F.pmod(_row_hash(fields), F.col("_parts"))
        rows = _with_parts(rows, hot, keys).withColumn("part", F.coalesce(cut, F.lit(0)).cast("int"))
        # Spread by part before the lists are built, not by key alone.
        rows = rows.repartition(*keys, "part")
    item = F.struct(*[F.col(c) for c in fields])
    lists = rows.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(item)).alias(child.into))
    if fields != child.element:
        chosen = F.transform(child.into, lambda x: F.struct(*[x[c].alias(c) for c in child.element]))
        lists = lists.withColumn(child.into, chosen)
    return lists


def pack(child: Children, keys: list[str], max_items: int = MAX_ITEMS) -> DataFrame:
    """Rows of a key as sorted arrays: keys, ``part`` and the array.

    A key that weighs more than ``max_items`` is cut by hash into parts of about
    that weight; nothing is dropped and no array outgrows a row.  All other keys
    have part 0 only.
    """
    return _pack(child, keys, _hot_keys([child], keys, max_items))


def nest(parent: DataFrame, keys: list[str], children: list[Children], max_items: int = MAX_ITEMS) -> DataFrame:
    """Arrays of child rows on their parent row, empty when there are none.

    A parent with too many children appears once per ``part``, each child in
    exactly one of them.  Lists are joined where they were built, by key and
    part; only the narrow parent rows move.
    """
    hot = _hot_keys(children, keys, max_items)
    if hot is None:
        rows = parent.withColumn("part", F.lit(0))
    else:
        last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
        rows = parent.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    for child in children:
        lists = _pack(child, keys, hot)
        empty = F.array().cast(lists.schema[child.into].dataType)
        rows = rows.join(lists, [*keys, "part"], "left").withColumn(child.into, F.coalesce(child.into, empty))
    return rows


def numbered_within(rows: DataFrame, group: str, order: str, into: str) -> DataFrame:
    """Position of each row of its group in ascending order, from 0; ``order`` is unique in a group.

    Rows are ranked inside range partitions, so a large group is ranked by many
    tasks.  One row per group and partition is left to add up.
    """
    ranged = rows.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id())
    # Written once, so that every later use sees the same partitions.
    placed = materialise(ranged, "ranged")
    sizes = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    inside = Window.partitionBy(group, "_part").orderBy(order)
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(sizes.select(group, "_part", earlier.alias("_before")), [group, "_part"])
        .withColumn(into, F.col("_before") + F.col("_rank") - 1)
        .drop("_part", "_rank", "_before")
    )


def top_per_group(counts: DataFrame, keys: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn(into, F.row_number().over(ranked)).where(F.col(into) <= k)


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()
