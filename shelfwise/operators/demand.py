"""Demand versus signals: engagement change beside the signals of the same window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import avg_where, count_where, tumbling

KEY = ["product_sku", "window_start", "window_end"]
GAPS = {"undercut": "UNDERCUT", "abrupt_inc": "PRICE_INCREASE_24H", "overpriced": "OVERPRICED"}


def signal_windows(signals: DataFrame) -> DataFrame:
    """Counts and mean absolute gaps of three signal types per (sku, five-minute window)."""
    at = F.coalesce("signal_timestamp", "op_ts") if "op_ts" in signals.columns else F.col("signal_timestamp")
    timed = signals.withColumn("event_time", at) if "event_time" not in signals.columns else signals
    kind = F.upper("signal_type")
    gap = F.abs(F.col("percentage_diff"))
    return (
        timed.groupBy("product_sku", tumbling(F.col("event_time")).alias("w"))
        .agg(
            *[count_where(kind == t).alias(f"{n}_cnt") for n, t in GAPS.items()],
            *[avg_where(kind == t, gap).cast("double").alias(f"avg_{n}_gap_pct") for n, t in GAPS.items()],
        )
        .select(
            "product_sku",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *[f"{n}_cnt" for n in GAPS],
            *[f"avg_{n}_gap_pct" for n in GAPS],
        )
    )


def behavior_with_previous(summary: DataFrame) -> DataFrame:
    """Search rate beside that of the window ending where this one starts; a gap gives NULL."""
    previous = summary.select(
        "product_sku",
        F.col("window_end").alias("window_start"),
        F.col("search_rate").alias("prev_search_rate"),
    )
    return summary.select(*KEY, "search_rate").join(previous, ["product_sku", "window_start"], "left").select(
        *KEY, "search_rate", "prev_search_rate"
    )


def score_windows(behavior: DataFrame) -> DataFrame:
    """Engagement delta, defaults, price position and score over already joined rows."""
    delta = F.col("search_rate") - F.coalesce("prev_search_rate", "search_rate")
    count = lambda n: F.coalesce(F.col(f"{n}_cnt"), F.lit(0)).cast("bigint")
    gap = lambda n: F.coalesce(F.col(f"avg_{n}_gap_pct"), F.lit(0.0))
    position = (
        F.when(gap("undercut") > 0, "competitor_cheaper").when(gap("overpriced") > 0, "we_cheaper").otherwise("unknown")
    )
    return behavior.select(
        *KEY,
        delta.alias("engagement_delta"),
        *[count(n).alias(f"{n}_cnt") for n in GAPS],
        *[F.round(gap(n), 2).try_cast("decimal(5,2)").alias(f"avg_{n}_gap_pct") for n in GAPS],
        position.alias("price_position"),
        (delta + count("undercut") * F.lit(0.01)).alias("score"),
    )


def demand_vs_signals(summary: DataFrame, signals: DataFrame) -> DataFrame:
    return score_windows(behavior_with_previous(summary).join(signal_windows(signals), KEY, "left"))
