"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.session import size_shuffles, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_shuffles(tune(spark), sf_dir)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql.strip()
        return build

    return register


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def rounded(column: str | Column, places: int = 6, name: str | None = None) -> Column:
    """Rounded double without a negative zero."""
    if isinstance(column, str):
        return F.expr(f"round(CAST({column} AS DOUBLE), {places}) + 0.0D AS {name or column}")
    return (F.round(column.cast("double"), places) + F.lit(0.0)).alias(name)


def whole(*columns: str) -> list[Column]:
    return [F.expr(f"CAST({c} AS BIGINT) AS {c}") for c in columns]


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column}"


def sql_round(expr: str, name: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0::DOUBLE AS {name}"


def sql_int(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"
