"""Cut points in shared storage and the small table helpers every operator uses."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where the session names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/llm-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    The lineage ends here, so a lost executor costs a re-read and nothing is computed twice, and
    the planner knows the true size: it broadcasts the table only when it is under its threshold.
    """
    place = f"{shared_folder(df.sparkSession)}/rows"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; further columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
