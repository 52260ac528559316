"""Latest prices and the per-product market summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import instant, pct_of


def latest_prices(prices: DataFrame) -> DataFrame:
    """Newest record per (sku, competitor)."""
    order = F.struct("event_time", "api_collection_ts_ms", "source_sku", "price")
    return (
        prices.groupBy("product_sku", "competitor_name")
        .agg(F.max_by(F.struct("price", "in_stock", "event_time"), order).alias("r"))
        .select("product_sku", "competitor_name", "r.*")
    )


def _with_code(latest: DataFrame) -> DataFrame:
    return latest.withColumn("competitor_code", F.lower("competitor_name"))


def competitor_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("product_sku").agg(
        F.count(F.lit(1)).cast("int").alias("competitor_count"),
        F.sum(F.when(F.col("in_stock"), 1).otherwise(0)).cast("int").alias("in_stock_competitor_count"),
    )


def cheapest_competitor(latest: DataFrame) -> DataFrame:
    """Lowest latest price per sku, stock ignored; equal prices fall to the first competitor code."""
    return (
        _with_code(latest)
        .groupBy("product_sku")
        .agg(
            F.min_by(
                F.struct("competitor_code", "price", "event_time"), F.struct("price", "competitor_code")
            ).alias("c")
        )
        .select("product_sku", "c.*")
    )


def product_market_summary(prices: DataFrame, products: DataFrame, competitors: DataFrame, as_of) -> DataFrame:
    """Cheapest competitor, gap and competitor counts per product.

    The cheapest record and the counts come out of one aggregation over the latest prices,
    so the sku shuffle happens once and needs no join of the two.
    """
    per_sku = (
        _with_code(latest_prices(prices))
        .groupBy("product_sku")
        .agg(
            F.min_by(F.struct("competitor_code", "price"), F.struct("price", "competitor_code")).alias("c"),
            F.count(F.lit(1)).cast("int").alias("competitor_count"),
            F.sum(F.when(F.col("in_stock"), 1).otherwise(0)).cast("int").alias("in_stock_competitor_count"),
        )
    )
    theirs = competitors.select("code", F.col("id").alias("cheapest_competitor_id"))
    ours = products.select(F.col("sku").alias("product_sku"), F.col("current_price").alias("platform_price"))
    gap = pct_of(F.col("platform_price") - F.col("c.price"), F.col("platform_price"))
    return (
        per_sku.join(theirs, F.col("c.competitor_code") == F.col("code"))
        .join(ours, "product_sku")
        .select(
            "product_sku",
            "cheapest_competitor_id",
            F.col("c.price").alias("cheapest_price"),
            "platform_price",
            gap.try_cast("decimal(6,2)").alias("gap_pct"),
            "competitor_count",
            "in_stock_competitor_count",
            instant(as_of).alias("summary_timestamp"),
        )
    )
