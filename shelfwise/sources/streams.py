"""Competitor prices, shopper behaviour and row changes as batch or streaming frames.

Records arrive as JSON text with an arrival time. Files are the built-in transport;
``kafka_records`` gives the same two columns where the Kafka connector is deployed.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.config import DEFAULTS
from shelfwise.functions.columns import instant
from shelfwise.operators import prices


def with_watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Event-time bound on a stream; a batch frame passes through."""
    return df.withWatermark(column, delay) if df.isStreaming else df


def file_records(spark: SparkSession, path: str, streaming: bool, files_per_batch: int | None = None) -> DataFrame:
    """Lines of text files with the file's modification time as arrival time."""
    if streaming:
        reader = spark.readStream
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = spark.read
    return reader.text(path).select("value", F.col("_metadata.file_modification_time").alias("timestamp"))


def kafka_records(
    spark: SparkSession, servers: str, topic: str, streaming: bool, starting: str = "earliest", started_at=None, **options: str
) -> DataFrame:
    """Topic values with the broker time; needs the Kafka connector on the class path.

    ``starting`` is ``earliest``, ``latest`` or offsets as JSON; a time in ``started_at`` starts every
    partition there instead. The checkpoint keeps the position from then on. ``options`` go to the connector.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    raw = reader.options(**kafka_options(servers, topic, starting, started_at, **options))
    return raw.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def kafka_options(servers: str, topic: str, starting: str = "earliest", started_at=None, **options: str) -> dict[str, str]:
    position = {"startingOffsets": starting}
    if started_at is not None:
        millis = int(_utc(started_at).timestamp() * 1000)
        position = {"startingTimestamp": str(millis), "startingOffsetsByTimestampStrategy": "latest"}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **position, **options}


def _utc(at) -> datetime:
    at = datetime.fromisoformat(at) if isinstance(at, str) else at
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def fixed_start(spark: SparkSession, checkpoint: str) -> str:
    """When a query with this checkpoint folder first started: stored there once, the same after every restart."""
    place = f"{checkpoint.rstrip('/')}/started_at"
    try:
        return spark.read.schema("at string").text(place).first()["at"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    spark.createDataFrame([(now,)], "at string").coalesce(1).write.text(place)
    return now


def starting_from(records: DataFrame, starting: str, started_at=None) -> DataFrame:
    """``earliest`` keeps everything, ``latest`` only what arrived since ``started_at``.

    A stream needs that time: its own clock moves on with every batch (see ``fixed_start``).
    """
    if starting == "earliest":
        return records
    if starting != "latest":
        raise ValueError(f"unknown starting position {starting!r}")
    if started_at is None and records.isStreaming:
        raise ValueError("a stream that starts at the latest record needs the time it started, or its checkpoint folder")
    since = F.current_timestamp() if started_at is None else instant(started_at)
    return records.filter(F.col("timestamp") >= since)


def _started(spark: SparkSession, records: DataFrame, starting: str, started_at, checkpoint: str | None) -> DataFrame:
    if starting == "latest" and started_at is None and checkpoint:
        started_at = fixed_start(spark, checkpoint)
    return starting_from(records, starting, started_at)


def _decoded(records: DataFrame, schema: str, required: str) -> DataFrame:
    """Typed records; text that does not parse, or lacks the required field, is skipped."""
    doc = records.select(F.from_json("value", schema).alias("d"), "timestamp")
    return doc.select("d.*", "timestamp").filter(F.col(required).isNotNull())


def parse_competitor_prices(records: DataFrame) -> DataFrame:
    typed = _decoded(records, schemas.COMPETITOR_PRICE, "product_sku").withColumnRenamed("timestamp", "kafka_ts")
    return with_watermark(prices.with_event_time(typed), "event_time", DEFAULTS.price_watermark)


def parse_user_behavior(records: DataFrame) -> DataFrame:
    typed = _decoded(records, schemas.USER_BEHAVIOR, "sku").drop("timestamp")
    timed = typed.withColumn("event_time", F.timestamp_millis("data_ts_ms"))
    return with_watermark(timed, "event_time", DEFAULTS.behavior_watermark)


def read_competitor_prices(
    spark: SparkSession, path: str, streaming: bool = True, starting: str = "earliest", started_at=None,
    files_per_batch: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """``starting="latest"`` skips what arrived before ``started_at``, or before the first start with ``checkpoint``."""
    records = file_records(spark, path, streaming, files_per_batch)
    return parse_competitor_prices(_started(spark, records, starting, started_at, checkpoint))


def read_user_behavior(
    spark: SparkSession, path: str, streaming: bool = True, starting: str = "earliest", started_at=None,
    files_per_batch: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    records = file_records(spark, path, streaming, files_per_batch)
    return parse_user_behavior(_started(spark, records, starting, started_at, checkpoint))


def read_changelog(spark: SparkSession, path: str, row: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Captured changes of one table: operation, commit time, row before and after."""
    records = file_records(spark, path, streaming, files_per_batch)
    return _decoded(records, schemas.change_event(row), "op").drop("timestamp")


def read_table_changes(spark: SparkSession, path: str, streaming: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """Captured changes of several tables: the table, the row's key, operation, commit time, and the row after as JSON text."""
    records = file_records(spark, path, streaming, files_per_batch)
    return _decoded(records, "source string, row_key string, op string, op_ts timestamp, after string", "row_key").drop("timestamp")
