"""How often customers come back with the same claim."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CODE_COLUMNS = [f"detail_category_{i}_code" for i in range(1, 6)]

# Result column and number of earlier rows or days it covers.
FRAMES = {
    "recontact_past_24h": 1,
    "recontact_past_3d": 2,
    "recontact_past_7d": 6,
    "recontact_past_30d": 29,
}
MEASURES = ["recontact_agg_day", *FRAMES]
LOOKBACK_DAYS = 35


def claim_codes(messages: DataFrame, classified: DataFrame, since: date | None = None) -> DataFrame:
    """One row per claim message and category code it was given."""
    recent = messages.select("id", "ccod", "created_at")
    if since is not None:
        recent = recent.where(F.col("created_at") >= F.lit(since))
    claims = classified.where("is_claim = 1").select(F.col("msg_id").alias("id"), *CODE_COLUMNS)
    codes = F.filter(F.array(*CODE_COLUMNS), lambda c: c.isNotNull())
    return recent.join(claims, "id").select(
        "id", "ccod", F.to_date("created_at").alias("aggregate_date"), F.explode(codes).alias("category_code")
    )


def claim_days(classified: DataFrame, since: date | None = None) -> DataFrame:
    """One row per category code of a claim: ``ccod``, ``category_code``, ``aggregate_date``.

    ``classified`` holds the customer and the codes in one row, so streams can use it too.
    """
    codes = F.filter(F.array(*CODE_COLUMNS), lambda c: c.isNotNull())
    claims = classified.where("is_claim = 1")
    if since is not None:
        claims = claims.where(F.col("created_at") >= F.lit(since))
    return claims.select("ccod", F.to_date("created_at").alias("aggregate_date"), F.explode(codes).alias("category_code"))


def daily_counts(codes: DataFrame) -> DataFrame:
    return codes.groupBy("aggregate_date", "ccod", "category_code").agg(F.count(F.lit(1)).alias("daily"))


def rolling_counts(daily: DataFrame, frame: str = "rows") -> DataFrame:
    """Counts over the current and earlier active days, less the current contact.

    ``rows`` counts active days, ``calendar`` counts real days.  The window
    sees one row per day and key, never single messages.
    """
    keys = Window.partitionBy("ccod", "category_code")
    if frame == "rows":
        ordered = keys.orderBy("aggregate_date")
        spans = {c: ordered.rowsBetween(-n, 0) for c, n in FRAMES.items()}
    elif frame == "calendar":
        ordered = keys.orderBy(F.unix_date("aggregate_date"))
        spans = {c: ordered.rangeBetween(-n, 0) for c, n in FRAMES.items()}
    else:
        raise ValueError(f"frame must be 'rows' or 'calendar', not {frame!r}")
    return daily.select(
        "aggregate_date", "ccod", "category_code",
        (F.col("daily") - 1).alias("recontact_agg_day"),
        *[(F.sum("daily").over(w) - 1).alias(c) for c, w in spans.items()],
    )


def with_category_name(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    names = taxonomy.select(F.col("voc_id").alias("category_code"), F.col("name").alias("category_name"))
    return counts.join(names, "category_code", "left")


def recontacts(
    messages: DataFrame,
    classified: DataFrame,
    taxonomy: DataFrame,
    as_of: date,
    frame: str = "rows",
    lookback: int = LOOKBACK_DAYS,
    only_today: bool = False,
) -> DataFrame:
    """Re-contact counts per customer, category and day of the lookback."""
    codes = claim_codes(messages, classified, as_of - timedelta(days=lookback))
    if only_today:
        # Only keys that were active today can have a row today.
        today = codes.where(F.col("aggregate_date") == F.lit(as_of)).select("ccod", "category_code").distinct()
        codes = codes.join(today, ["ccod", "category_code"], "left_semi")
    counts = rolling_counts(daily_counts(codes), frame)
    if only_today:
        counts = counts.where(F.col("aggregate_date") == F.lit(as_of))
    return with_category_name(counts, taxonomy).select(
        "aggregate_date", "ccod", "category_code", "category_name", *MEASURES
    )


def first_message_per_receipt(messages: DataFrame) -> DataFrame:
    """The smallest message id of every receipt number."""
    return messages.groupBy("rcno").agg(F.min("id").alias("msg_id"))


def with_message_id(received: DataFrame, messages: DataFrame) -> DataFrame:
    return received.join(first_message_per_receipt(messages), "rcno", "left")
