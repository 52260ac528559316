"""Trend and movement reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import ago, arranged, bucket_start, count_where, exact_avg, in_selection
from shelfwise.functions.distribution import histogram

PAIR = ["product_sku", "competitor_code"]


def recent_trends(
    trends: DataFrame, as_of, days: int = 1, skus: Sequence[str] = (), codes: Sequence[str] = (), ordered: bool = False
) -> DataFrame:
    rows = (
        trends.filter(F.col("window_end") > ago(as_of, days=days))
        .withColumnRenamed("competitor_name", "competitor_code")
        .filter(in_selection(F.col("product_sku"), skus) & in_selection(F.col("competitor_code"), codes))
    )
    return rows.orderBy(F.col("window_end").desc()) if ordered else rows


def trend_shares(trends: DataFrame) -> DataFrame:
    """Counts and percentages of window directions, as one row."""
    kind = F.col("trend_direction")
    counts = trends.agg(
        count_where(kind == "up").alias("windows_up"),
        count_where(kind == "down").alias("windows_down"),
        count_where(kind == "stable").alias("windows_stable"),
        F.nullif(F.count(kind), F.lit(0)).alias("n"),
    )
    pct = lambda c: F.coalesce(F.col(c) / F.col("n") * 100, F.lit(0.0))
    return counts.select(
        "windows_up",
        "windows_down",
        "windows_stable",
        pct("windows_up").alias("up_pct"),
        pct("windows_down").alias("down_pct"),
        F.greatest(F.lit(0.0), F.lit(100.0) - pct("windows_up") - pct("windows_down")).alias("stable_pct"),
    )


def price_movers(trends: DataFrame) -> DataFrame:
    """First and last window average per pair with net and percentage change."""
    ends = trends.groupBy(*PAIR).agg(
        F.min_by("avg_price", "window_start").alias("first_price"),
        F.max_by("avg_price", "window_start").alias("last_price"),
    )
    first = F.col("first_price").cast("double")
    change = F.col("last_price").cast("double") - first
    return (
        ends.withColumn("net_change", F.col("last_price") - F.col("first_price"))
        .withColumn("pct_change", change / F.nullif(first, F.lit(0.0)) * 100)
        .filter(F.col("pct_change").isNotNull())
    )


def top_movers(trends: DataFrame, n: int = 5, rising: bool = True) -> DataFrame:
    pct = F.col("pct_change")
    return price_movers(trends).orderBy(pct.desc() if rising else pct.asc(), *PAIR).limit(n)


def volatility_ranking(trends: DataFrame, ordered: bool = False) -> DataFrame:
    return (
        trends.groupBy(*PAIR)
        .agg(exact_avg(F.col("price_volatility")).alias("price_volatility"))
        .transform(arranged, ordered, F.col("price_volatility").desc(), *PAIR)
    )


def hourly_prices(trends: DataFrame) -> DataFrame:
    """Mean window average per pair and hour, in long form."""
    return trends.groupBy(*PAIR, F.date_trunc("hour", "window_end").alias("hour")).agg(
        exact_avg(F.col("avg_price")).alias("avg_price")
    )


def hourly_price_pivot(trends: DataFrame, hours: Sequence[str]) -> DataFrame:
    """One column per given full hour (``yyyy-MM-dd HH:mm``), days apart; naming the hours spares a pass to discover them."""
    labelled = trends.select(
        F.concat_ws(" | ", *PAIR).alias("product_competitor"),
        F.date_format(F.date_trunc("hour", "window_end"), "yyyy-MM-dd HH:mm").alias("hour"),
        "avg_price",
    )
    return labelled.groupBy("product_competitor").pivot("hour", list(hours)).agg(exact_avg(F.col("avg_price")))


def volatility_by_pair(trends: DataFrame) -> DataFrame:
    return trends.groupBy("competitor_code", "product_sku").agg(
        exact_avg(F.col("price_volatility")).alias("price_volatility")
    )


def volatility_pivot(trends: DataFrame, skus: Sequence[str]) -> DataFrame:
    """Competitor by sku matrix for the chosen skus."""
    return (
        trends.filter(F.col("product_sku").isin(list(skus)))
        .groupBy("competitor_code")
        .pivot("product_sku", list(skus))
        .agg(exact_avg(F.col("price_volatility")))
    )


def recent_movements(
    movements: DataFrame, competitors: DataFrame, as_of, days: int = 1, ordered: bool = False
) -> DataFrame:
    codes = competitors.select(F.col("id").alias("competitor_id"), F.col("code").alias("competitor_code"))
    rows = (
        movements.filter(F.col("event_time") > ago(as_of, days=days))
        .join(codes, "competitor_id")
        .withColumn("bucket_5m", bucket_start(F.col("event_time"), 300))
    )
    return rows.orderBy(F.col("event_time").desc()) if ordered else rows


def movement_counts(movements: DataFrame) -> DataFrame:
    return movements.groupBy("bucket_5m", "direction").agg(F.count(F.lit(1)).alias("movements"))


def movement_direction_counts(movements: DataFrame) -> DataFrame:
    return movements.groupBy("direction").agg(F.count(F.lit(1)).alias("movements"))


def movement_histogram(movements: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(movements.select(F.abs("pct_change").alias("abs_pct_change")), "abs_pct_change", bins)


def latest_movements(movements: DataFrame, n: int = 500) -> DataFrame:
    order = [F.col("event_time").desc(), "product_sku", "competitor_code", "new_price", "previous_price"]
    return movements.orderBy(*order).limit(n).select(
        "event_time", "product_sku", "competitor_code", "previous_price", "new_price", "pct_change", "direction"
    )


def movements_or_all(movements: DataFrame, skus: Sequence[str] = (), codes: Sequence[str] = ()) -> DataFrame:
    """Movements of the selection, or all of them when the selection matches none."""
    chosen = in_selection(F.col("product_sku"), skus) & in_selection(F.col("competitor_code"), codes)
    matched = movements.agg(F.coalesce(F.max(chosen), F.lit(False))).scalar()
    return movements.filter(chosen | ~matched)
