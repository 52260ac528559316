"""Competitor price history and five-minute trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import tumbling

PRICE_COLUMNS = ("price", "in_stock", "source_sku", "api_collection_ts_ms", "kafka_ts")


def with_event_time(records: DataFrame) -> DataFrame:
    """Event time: data time, else collection time, else broker time."""
    return records.withColumn(
        "event_time",
        F.coalesce(F.timestamp_millis("data_ts_ms"), F.timestamp_millis("api_collection_ts_ms"), F.col("kafka_ts")),
    )


def dedup_prices(prices: DataFrame) -> DataFrame:
    """Newest broker record per (sku, competitor, data time); records without a data time are dropped.

    A ``max_by`` aggregate instead of ``row_number``: it combines map-side, so a key that
    repeats often shrinks before the shuffle and a hot key is never sorted whole. The number
    leads the group because rows are sorted by it, and skus begin alike.
    """
    key = ["product_sku", "competitor_name", "data_ts_ms"]
    newest = F.max_by(
        F.struct(*PRICE_COLUMNS), F.struct("kafka_ts", "source_sku", "price", "in_stock")
    ).alias("r")
    return (
        prices.filter(F.col("data_ts_ms").isNotNull())
        .groupBy(F.xxhash64(*key).alias("_hash"), *key)
        .agg(newest)
        .select(*key, "r.*")
    )


def competitor_price_history(prices: DataFrame, competitors: DataFrame) -> DataFrame:
    """Deduplicated prices of known competitors with both timestamps."""
    codes = competitors.select("code", F.col("id").alias("competitor_id"))
    return (
        dedup_prices(prices)
        .join(codes, F.lower("competitor_name") == F.col("code"))
        .select(
            "product_sku",
            "competitor_id",
            "price",
            "in_stock",
            "source_sku",
            F.timestamp_millis("data_ts_ms").alias("data_timestamp"),
            F.timestamp_millis("api_collection_ts_ms").alias("collection_timestamp"),
        )
    )


def _window_aggregates(prices: DataFrame, *extra) -> DataFrame:
    cents = (F.col("price") * 100).cast("decimal(10,0)")
    n, total, squares = F.count(cents), F.sum(cents), F.sum(cents * cents)
    # n * sum(x^2) - sum(x)^2 is exact in integer cents, so the deviation carries no cancellation error
    spread = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)") - (total * total)).cast("double")
    deviation = F.round(F.sqrt(F.greatest(spread, F.lit(0.0))) / n) / 100
    return prices.groupBy("product_sku", "competitor_name", tumbling(F.col("event_time")).alias("w")).agg(
        F.avg("price").cast("decimal(10,2)").alias("avg_price"),
        deviation.try_cast("decimal(5,2)").alias("price_volatility"),
        F.min("event_time").alias("min_ts"),
        F.max("event_time").alias("max_ts"),
        *extra,
    )


def price_window_stats(prices: DataFrame) -> DataFrame:
    """Average, population deviation and first/last event time per five-minute window."""
    return _window_aggregates(prices).select(
        "product_sku",
        "competitor_name",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "avg_price",
        "price_volatility",
        "min_ts",
        "max_ts",
    )


def price_trends(prices: DataFrame) -> DataFrame:
    """Window statistics plus direction from the first to the last price, in one aggregation.

    Among records sharing the first or the last instant the highest price counts. Works on
    batch and watermarked streaming input alike.
    """
    at = F.col("event_time")
    first = F.min_by("price", F.struct(at, -F.col("price"))).alias("first_price")
    last = F.max_by("price", F.struct(at, F.col("price"))).alias("last_price")
    direction = (
        F.when(F.col("first_price") < F.col("last_price"), "up")
        .when(F.col("first_price") > F.col("last_price"), "down")
        .otherwise("stable")
    )
    return _window_aggregates(prices, first, last).select(
        "product_sku",
        "competitor_name",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "avg_price",
        "price_volatility",
        direction.alias("trend_direction"),
    )
