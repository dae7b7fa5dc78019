"""Operational databases over JDBC.

Connections are profiles given by the caller; nothing here knows a host or a
password.  Failures raise.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

# Named query templates.  Keys are joined, not pasted into the text, and times
# are bound as parameters of the template.
TEMPLATES = {
    "customer_codes": "SELECT DISTINCT custcode AS ccod FROM customer",
    "messages": (
        "SELECT rcno, rcdt, rctm, indt, ctcd AS ccod, cmmo AS content "
        "FROM voc_master WHERE indt >= '{start}' AND indt < '{end}'"
    ),
    "contracts": "SELECT * FROM contract WHERE contract_date <= '{as_of}'",
    "purchases": "SELECT * FROM purchase WHERE purchase_date <= '{as_of}'",
    "works": "SELECT * FROM work WHERE work_date <= '{as_of}'",
    "surveys": "SELECT * FROM survey WHERE survey_date <= '{as_of}'",
    "work_details": "SELECT * FROM work_detail",
    "personal_works": "SELECT * FROM personal_work WHERE work_date <= '{as_of}'",
    "personal_work_details": "SELECT * FROM personal_work_detail",
    "prospects": "SELECT * FROM prospect WHERE registered_at >= '{one_month_ago}'",
}

STAMP = "%Y-%m-%d %H:%M:%S"


@dataclass(frozen=True)
class Profile:
    """Where and how to connect; the password is read from ``secrets``."""

    url: str
    driver: str
    user: str
    secrets: dict[str, str] = field(default_factory=dict, repr=False)
    fetch_size: int = 10_000


def bind(name: str, **values: datetime | str) -> str:
    """Template text with its parameters; times become literal stamps."""
    texts = {}
    for key, value in values.items():
        text = value.strftime(STAMP) if isinstance(value, datetime) else str(value)
        if "'" in text or ";" in text:
            raise ValueError(f"unsafe value for {key}")
        texts[key] = text
    return TEMPLATES[name].format(**texts)


def last_hour(now: datetime) -> tuple[datetime, datetime]:
    """Default range of the hourly run."""
    return now - timedelta(hours=1), now


def options(
    profile: Profile,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Reader options.  A big scan is split on a numeric or date column.

    A split needs the query as a sub-select, since the plain query option
    takes no partition column.
    """
    base = {
        "url": profile.url,
        "driver": profile.driver,
        "user": profile.user,
        "fetchsize": str(profile.fetch_size),
        **profile.secrets,
    }
    if partition_column is None:
        return base | {"query": query}
    if bounds is None:
        raise ValueError("a partitioned scan needs bounds")
    return base | {
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def scan(spark: SparkSession, profile: Profile, query: str, **split) -> DataFrame:
    return spark.read.format("jdbc").options(**options(profile, query, **split)).load()
