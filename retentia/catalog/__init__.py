"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

from retentia.catalog import customers, recommendations, segments, tables, voc  # noqa: F401
from retentia.catalog.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
