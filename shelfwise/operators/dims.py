"""Captured row changes to keyed dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _op_rank() -> Column:
    return F.when(F.col("op") == "d", 2).when(F.col("op") == "u", 1).otherwise(0)


def latest_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last change event per key: (keys, op, op_ts, after). Equal commit times put a delete last."""
    keyed = changes.select(
        *[F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys], "op", "op_ts", "after"
    )
    return (
        keyed.groupBy(*keys)
        .agg(F.max_by(F.struct("op", "op_ts", "after"), F.struct("op_ts", _op_rank(), "after")).alias("c"))
        .select(*keys, "c.*")
    )


def apply_changelog(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows with their commit time; a key whose last event is a delete is gone."""
    return latest_changes(changes, keys).filter(F.col("op") != "d").select("after.*", "op_ts")


def _op_ts(df: DataFrame) -> Column:
    return F.col("op_ts") if "op_ts" in df.columns else F.lit(None).cast("timestamp")


def products_dim(products: DataFrame) -> DataFrame:
    return products.select(
        "sku",
        "current_price",
        "price_sensitivity",
        "in_stock",
        "is_active",
        F.coalesce("updated_at", "created_at", _op_ts(products)).alias("dim_time"),
    )


def competitors_dim(competitors: DataFrame) -> DataFrame:
    return competitors.select("code", "id", "name", F.coalesce("created_at", _op_ts(competitors)).alias("dim_time"))


def behavior_dim(summary: DataFrame) -> DataFrame:
    return summary.select(
        "product_sku", "window_start", "window_end", "unique_visitors", "page_views", "searches", "cart_additions",
        "purchases", "price_comparisons", "search_rate", "search_cart_rate", "cart_purchase_rate",
        "view_compare_rate", "avg_dwell_seconds", _op_ts(summary).alias("op_ts"),
    )


def signals_dim(signals: DataFrame) -> DataFrame:
    return signals.select(
        "product_sku", "competitor_id", "signal_type", "percentage_diff", "platform_price", "competitor_price",
        "recommendation", "priority", "in_stock", "signal_timestamp", "is_active", _op_ts(signals).alias("op_ts"),
    )
