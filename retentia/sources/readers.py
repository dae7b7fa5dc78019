"""Reading tables: Parquet, CSV dimensions, JSON lines, and month partitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY_DDL = "voc_id string, name string, parent_id string, level double"
INDUSTRY_DDL = "code string, name string"
EXAMPLE_DDL = "input_text string, category_dict string, response string"


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def month_partition(spark: SparkSession, path: str, month: date, column: str = "snapshot_month") -> DataFrame:
    """One month of a partitioned table; other months are not listed or read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(month.replace(day=1)))


def csv_dimension(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV with a header and a fixed schema; Windows line ends are fine."""
    return spark.read.csv(path, schema=ddl, header=True, mode="FAILFAST", ignoreTrailingWhiteSpace=True)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples, one JSON object per line or one JSON array per file."""
    return spark.read.json(path, schema=EXAMPLE_DDL, multiLine=path.endswith(".json"), mode="FAILFAST")


def between(column: str, start, end, closed: bool = False) -> Column:
    """Half-open time range, or a closed one."""
    upper = F.col(column) <= F.lit(end) if closed else F.col(column) < F.lit(end)
    return (F.col(column) >= F.lit(start)) & upper


def as_of(rows: DataFrame, column: str, day: date) -> DataFrame:
    """Rows known on a day."""
    return rows.where(F.col(column) <= F.lit(day))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Source names to domain names; only the named columns are kept."""
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()])
