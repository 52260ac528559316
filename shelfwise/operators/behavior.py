"""Shopper behaviour events and their five-minute summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import ratio_or_zero, tumbling

COUNTERS = ["page_views", "unique_visitors", "searches", "cart_additions", "purchases", "price_comparisons"]


def behavior_events(src: DataFrame) -> DataFrame:
    return src.select(
        F.col("sku").alias("product_sku"),
        "page_views",
        "unique_visitors",
        "dwell_seconds",
        "searches",
        "cart_additions",
        "purchases",
        "price_comparisons",
        F.timestamp_millis("data_ts_ms").alias("data_timestamp"),
        F.timestamp_millis("api_collection_ts_ms").alias("collection_timestamp"),
    )


def behavior_summary(src: DataFrame) -> DataFrame:
    """Counters, guarded ratios and mean dwell per (sku, five-minute window); batch or streaming."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in COUNTERS]
    windowed = src.groupBy(F.col("sku").alias("product_sku"), tumbling(F.col("event_time")).alias("w")).agg(
        *sums, F.avg("dwell_seconds").alias("avg_dwell_seconds")
    )
    rate = lambda num, den: ratio_or_zero(F.col(num), F.col(den))
    return windowed.select(
        "product_sku",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *COUNTERS,
        rate("searches", "page_views").alias("search_rate"),
        rate("cart_additions", "searches").alias("search_cart_rate"),
        rate("purchases", "cart_additions").alias("cart_purchase_rate"),
        rate("price_comparisons", "page_views").alias("view_compare_rate"),
        "avg_dwell_seconds",
    )
