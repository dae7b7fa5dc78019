"""Streaming forms of the message aggregates.

Each wraps the finished batch transform; state is kept by Spark or as tables
whose batches replace themselves when they are repeated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from datetime import date, datetime
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.numbers import histogram_bin
from retentia.operators import health, recontact
from retentia.sources import sinks
from retentia.streaming.ingest import event_time, keep_batch, run_available

# Rows of a result that a task holds at once, besides those of one key.
ROWS_AT_ONCE = 50_000


def hourly_counts(rows: DataFrame, time: str, category: str) -> DataFrame:
    """Messages per hour and category."""
    return (
        rows.withColumn(time, F.col(time).cast("timestamp"))
        .groupBy(F.window(time, "1 hour"), F.col(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour"), "category", "n")
    )


def store_hourly_counts(rows: DataFrame, time: str, category: str, path: str, checkpoint: str) -> None:
    """Keeps the counts of every batch; they add up, however late a row comes."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        keep_batch(path)(hourly_counts(batch, time, category), batch_id)

    run_available(rows, checkpoint, handle)


def total_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("hour", "category").agg(F.sum("n").alias("n"))


def _partial_days(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per key and day of each batch of rows, so that a very common key brings few rows to its task."""
    keys = ["ccod", "category_code", "day"]
    for frame in frames:
        yield frame.groupby(keys, dropna=False, as_index=False).size().rename(columns={"size": "n"})


def recount(days: dict[int, int], touched: list[int], frame: str, lookback: int) -> list[tuple[int, ...]]:
    """Measures of the days that a change to the ``touched`` ones can alter.

    ``days`` are the active days of a key, as numbers, with their counts.  A day
    counts itself and earlier active days within ``lookback``.
    """
    order = sorted(days)
    upto = [0, *accumulate(days[d] for d in order)]
    rows = []
    for at in range(bisect_left(order, min(touched)), bisect_right(order, max(touched) + lookback)):
        day = order[at]
        oldest = bisect_left(order, day - lookback)
        if frame == "rows":
            firsts = [max(oldest, at - n) for n in recontact.FRAMES.values()]
        else:
            firsts = [max(oldest, bisect_left(order, day - n)) for n in recontact.FRAMES.values()]
        rows.append((day, days[day] - 1, *[upto[at + 1] - upto[first] - 1 for first in firsts]))
    return rows


def _recounted(frame: str, lookback: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The days to store of many keys at once: a row holds a key's days with counts, and which of them are ``fresh``."""
    columns = ["ccod", "category_code", "day", *recontact.MEASURES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for batch in frames:
            for ccod, code, listed, counts, fresh in zip(*[batch[c] for c in batch], strict=True):
                days: dict[int, int] = {}
                for day, n in zip(listed.tolist(), counts.tolist(), strict=True):
                    days[day] = days.get(day, 0) + n
                found += [(ccod, code, *row) for row in recount(days, fresh.tolist(), frame, lookback)]
                if len(found) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
        yield pd.DataFrame(found, columns=columns)

    return run


def maintain_recontacts(
    rows: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    taxonomy: DataFrame,
    folder: str,
    now: Column,
    frame: str = "rows",
    lookback: int = recontact.LOOKBACK_DAYS,
    since: date | None = None,
) -> tuple[str, list[dict]]:
    """Keeps the re-contact table up to date; returns its path and the progress of the last batches.

    ``prepare`` makes classified messages with their customer of the stream.
    The state store holds the active days of every key, with a count per batch
    that brought some; a batch reads the state of its own keys, recounts the
    days it can alter and merges those.  State is added to by Spark's own
    aggregation, as a Python call per key costs milliseconds.  The
    lookback ends at each day, so it moves with the data.  Rows count however
    late they come.  ``since`` leaves out older rows.
    """
    if frame not in ("rows", "calendar"):
        raise ValueError(f"frame must be 'rows' or 'calendar', not {frame!r}")
    claims = recontact.claim_days(prepare(rows), since).where("aggregate_date IS NOT NULL")
    days = claims.select("ccod", "category_code", F.unix_date("aggregate_date").alias("day"))
    partial = days.mapInPandas(_partial_days, "ccod string, category_code string, day int, n long")
    # The time of the batch, the same wherever a batch or its repetition asks for it; it tells the days that are new.
    timed = partial.withColumn("at", F.current_timestamp())
    keyed = timed.groupBy("ccod", "category_code").agg(F.collect_list(F.struct("day", "n", "at")).alias("e"))
    keyed = keyed.withColumn("now", F.current_timestamp())
    fresh = F.filter("e", lambda x: x["at"] == F.col("now"))
    lists = keyed.select("ccod", "category_code", F.col("e.day").alias("days"), F.col("e.n").alias("counts"), fresh["day"].alias("fresh"))
    measures = ", ".join(f"{m} long" for m in recontact.MEASURES)
    changed = lists.mapInPandas(_recounted(frame, lookback), f"ccod string, category_code string, day int, {measures}").select(
        F.date_from_unix_date("day").alias("aggregate_date"), "ccod", "category_code", *recontact.MEASURES
    )
    table = f"{folder}/activity"

    def handle(batch: DataFrame, batch_id: int) -> None:
        named = recontact.with_category_name(batch, taxonomy)
        sinks.upsert(
            named, table, f"{folder}/staging/{batch_id}", ["aggregate_date", "ccod", "category_code"], "aggregate_date", now
        )

    return table, run_available(changed, f"{folder}/checkpoint", handle, "update")


def collect_confidence(
    rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], start: datetime, middle: datetime, end: datetime, folder: str
) -> DataFrame:
    """Histogram counts per batch, and the drift over all of them."""
    period = F.when(health.in_range("created_at", start, middle), "baseline").when(
        health.in_range("created_at", middle, end), "current"
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        keep_batch(f"{folder}/histogram")(health.histogram(prepare(batch), "model_confidence", period), batch_id)

    run_available(rows, f"{folder}/checkpoint", handle)
    counts = rows.sparkSession.read.parquet(f"{folder}/histogram")
    return health.drift(counts.groupBy("period", "bin").agg(F.sum("n").alias("n")))


def windowed_confidence(rows: DataFrame, time: str, value: str, lateness: str = "2 hours") -> DataFrame:
    """Confidence histogram per day as a pure streaming aggregate.

    Rows later than ``lateness`` don't count; ``collect_confidence`` counts all.
    """
    return (
        event_time(rows, time, lateness)
        .withColumn("bin", histogram_bin(F.col(value), health.BINS))
        .groupBy(F.window(time, "1 day"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
