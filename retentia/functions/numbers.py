"""Guarded ratios, flags, buckets and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8

# Edges of the floor-area buckets; the last bucket is open.
AREA_EDGES = [22, 50, 258, 1600, 4950]
# What a missing coordinate or area stands for.
DEFAULT_LATITUDE, DEFAULT_LONGITUDE, DEFAULT_AREA = 37.5, 127.0, 50.0

FALSE_WORDS = ["FALSE", "F", "N", "0"]
TRUE_WORDS = ["TRUE", "T", "Y", "1"]


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def smooth_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(EPSILON))


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


def messy_boolean(value: Column) -> Column:
    """Boolean of the spellings found in the sources; unknown ones are null."""
    word = F.upper(F.trim(value.cast("string")))
    return F.when(word.isin(FALSE_WORDS), False).when(word.isin(TRUE_WORDS), True)


def area_bucket(area: Column) -> Column:
    number = lenient_double(area)
    bucket = F.lit(len(AREA_EDGES))
    for i in reversed(range(len(AREA_EDGES))):
        bucket = F.when(number <= AREA_EDGES[i], i).otherwise(bucket)
    return F.when(number.isNull() | F.isnan(number), 0).otherwise(bucket)


def round_even(value: Column, places: int) -> Column:
    """Half to even, without a negative zero."""
    return F.bround(value, places) + F.lit(0.0)


def histogram_bin(value: Column, bins: int = 10) -> Column:
    """Bin of a value in [0,1]; the last bin is closed, outsiders are null.

    Edges are multiples of the bin width in floating point, so 0.3 falls below
    its nominal edge 0.30000000000000004.
    """
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)])
    reached = F.size(F.filter(edges, lambda e: value >= e)) - 1
    return F.when((value >= 0.0) & (value <= 1.0) & ~F.isnan(value), reached)


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def similarity(dist: Column, longest: Column) -> Column:
    return F.lit(1.0) - dist / longest


