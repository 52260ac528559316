"""Batch tables and keyed dimension snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import ago, instant

DAY, BATCH = "stored_day", "stored_batch"


def read_table(spark: SparkSession, path: str, *, time_column: str | None = None, since=None, until=None) -> DataFrame:
    """A Parquet table, optionally within ``(since, until]`` of a time column.

    The range is a plain predicate, so it prunes partitions and row groups at the scan.
    """
    df = spark.read.parquet(path)
    if time_column and since is not None:
        df = df.filter(F.col(time_column) > instant(since))
    if time_column and until is not None:
        df = df.filter(F.col(time_column) <= instant(until))
    return df


def read_lookback(spark: SparkSession, path: str, time_column: str, as_of, *, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows of a table laid out by day that are not older than the look-back before ``as_of``.

    The range reaches the scan as a filter on the day folders, so older days are never listed as files to read; rows
    of the first day that are older than the look-back leave by the filter on their time. Rows without a time are left
    out. Columns are those that were written.
    """
    start = ago(as_of, days=days, hours=hours)
    df = spark.read.parquet(path).filter((F.col(DAY) >= F.to_date(start)) & (F.col(time_column) >= start))
    return df.drop(DAY, BATCH)
