"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression used inside a lambda is evaluated for every element; bound to
    a lambda variable it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
