"""History of a customer as sums per kind and moment, to which each month adds.

Trailing windows end at the customer's own latest moment, which only moves on.
So two tables are enough to go on from: the sums of everything per kind, and
the moments within the longest window of the latest one.  A moment that has
left the window never comes back; one that arrives late is added to the sums,
and to the moments if it still lies within.  A month reads those and its own
rows, not the history.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.dates import whole_days
from retentia.operators.groups import join_back, with_group_stats
from retentia.schemas import WINDOWS
from retentia.session import materialise
from retentia.sources import sinks

KEY = ["ccod", "kind"]


@dataclass(frozen=True)
class Measures:
    """What is summed: an expression per name, over all rows of a moment; ``dated`` ones only where the moment is known."""

    sums: dict[str, str]
    dated: tuple[str, ...] = ()

    def moments(self, rows: DataFrame, kind: Column, at: str) -> DataFrame:
        """One row per customer, kind and moment ``at``; combined map-side, so a customer with very many rows is spread."""
        keyed = rows.select("ccod", kind.alias("kind"), F.col(at).alias("at"), *[F.expr(e).alias(n) for n, e in self.sums.items()])
        return keyed.groupBy("ccod", "kind", "at").agg(*[F.sum(n).alias(n) for n in self.sums])

    def totals(self) -> list[Column]:
        """Sums of all moments, the first and the last one."""
        known = {n: F.when(F.col("at").isNotNull(), F.col(n)) if n in self.dated else F.col(n) for n in self.sums}
        return [*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in known.items()], F.min("at").alias("first_at"), F.max("at").alias("last_at")]

    def windows(self) -> list[Column]:
        """Sums of the moments at most so many days before ``_last``."""
        age = whole_days(F.col("_last"), F.col("at"))
        return [
            F.coalesce(F.sum(F.when(age <= d, F.col(n))), F.lit(0)).alias(f"{n}_{d}d") for d in WINDOWS for n in self.sums
        ]


def by_kind(moments: DataFrame, measures: Measures) -> DataFrame:
    """One row per customer and kind with all totals and windows, from a written table of all moments."""
    dated = with_group_stats(moments, ["ccod"], _last=F.max("at"))
    return dated.groupBy(*KEY).agg(*measures.totals(), *measures.windows())


@dataclass(frozen=True)
class State:
    """What later months need: ``totals`` per customer and kind, and the ``recent`` moments."""

    totals: DataFrame
    recent: DataFrame

    def by_kind(self, measures: Measures) -> DataFrame:
        """As ``by_kind`` of all moments."""
        inside = _with_last(self.recent, self.totals).groupBy(*KEY).agg(*measures.windows())
        names = [c for c in inside.columns if c not in KEY]
        same = F.col("ccod").eqNullSafe(F.col("_ccod")) & F.col("kind").eqNullSafe(F.col("_kind"))
        joined = self.totals.join(inside.withColumnsRenamed({"ccod": "_ccod", "kind": "_kind"}), same, "left")
        return joined.select(*self.totals.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])

    def store(self, path: str, month: date) -> None:
        """Replaces the month's state; a repeated run of the month ends with the same."""
        for rows, name in ((self.totals, "totals"), (self.recent, "recent")):
            sinks.reload(rows.hint("rebalance"), _folder(path, name, month))

    @staticmethod
    def load(spark: SparkSession, path: str, month: date) -> State:
        return State(*[spark.read.parquet(_folder(path, name, month)) for name in ("totals", "recent")])


def _folder(path: str, name: str, month: date) -> str:
    """Folder of a month's table; it has a schema even without rows."""
    return f"{path}/{name}/{sinks.MONTH}={month.replace(day=1)}"


def _with_last(moments: DataFrame, totals: DataFrame) -> DataFrame:
    last = totals.groupBy("ccod").agg(F.max("last_at").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    return join_back(moments, materialise(last, "last"), ["ccod"])


def advance(previous: State | None, new: DataFrame, measures: Measures) -> State:
    """The state after more moments; ``new`` is a written table and may hold moments of any age.

    ``recent`` is lazy, so storing it is its only write.
    """
    sums = list(measures.sums)
    totals = new.groupBy(*KEY).agg(*measures.totals())
    moments = new.where(F.col("at").isNotNull())
    if previous is not None:
        # New moments as totals of one moment each, so that both sides are added up by one grouping.
        known = [F.when(F.col("at").isNotNull(), F.col(n)).alias(n) if n in measures.dated else F.col(n) for n in sums]
        single = new.select(*KEY, *known, F.col("at").alias("first_at"), F.col("at").alias("last_at"))
        added = [*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
        totals = previous.totals.unionByName(single).groupBy(*KEY).agg(*added)
        moments = previous.recent.unionByName(moments)
    totals = materialise(totals, "totals")
    # Moments that left the window are dropped before the rest is added up.
    inside = _with_last(moments, totals).where(whole_days(F.col("_last"), F.col("at")) <= max(WINDOWS)).drop("_last")
    if previous is not None:
        inside = inside.groupBy(*KEY, "at").agg(*[F.sum(c).alias(c) for c in sums])
    return State(totals, inside)


def advance_month(
    spark: SparkSession, path: str, before: date | None, month: date, new: DataFrame, measures: Measures, *, written: bool = False
) -> State:
    """Stores the state of a month, from that of the month ``before`` and the rows of this one, and reads it back.

    ``written`` says that ``new`` is a stored table already.
    """
    previous = State.load(spark, path, before) if before else None
    advance(previous, new if written else materialise(new, "moments"), measures).store(path, month)
    return State.load(spark, path, month)
