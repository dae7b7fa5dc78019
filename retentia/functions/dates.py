"""Lenient date parsing and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings and the open-ended end date.
DATE_FORMATS = ["yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd"]
OPEN_ENDED = "99991231"
# Range of a nanosecond clock; anything beyond it counts as "no date".
FIRST_VALID, LAST_VALID = "1677-09-22", "2262-04-11"

SEOUL = "Asia/Seoul"


def parse_date(text: Column) -> Column:
    """Timestamp of a date text; null when unreadable or out of range."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS])
    return F.when(parsed.between(F.lit(FIRST_VALID).cast("timestamp"), F.lit(LAST_VALID).cast("timestamp")), parsed)


def is_open_ended(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.substring(F.trim(text), 1, 10), "-", "") == OPEN_ENDED, F.lit(False))


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed time in days (not calendar days)."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("int")


def from_date_and_hhmm(date_text: Column, hhmm: Column) -> Column:
    """Date text plus four-digit time text."""
    clock = F.concat(F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2), F.lit(":00"))
    return F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_replace(date_text, "-", ""), clock), F.lit("yyyyMMdd HH:mm:ss")
    )


def kst_to_utc(local: Column) -> Column:
    return F.convert_timezone(F.lit(SEOUL), F.lit("UTC"), local.cast("timestamp_ntz"))


def utc_to_kst(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(SEOUL), utc.cast("timestamp_ntz"))


def month_start(when: Column) -> Column:
    return F.trunc(when, "MM")


def month_label(when: Column) -> Column:
    return F.date_format(when, "yyyy_MM")


def next_month(when: Column) -> Column:
    return F.add_months(F.trunc(when, "MM"), 1)


def timestamp_text(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def json_array_text(text: Column) -> Column:
    """Array text as is; anything else becomes an empty array."""
    return F.when(F.startswith(text, F.lit("[")), text).otherwise("[]")
