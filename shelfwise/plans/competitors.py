"""Competitor analysis reports over price gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS
from shelfwise.functions.columns import ago, avg_where, count_where, exact_avg, in_selection
from shelfwise.functions.distribution import exact_median, histogram

GAP = "price_diff_percent"


def price_gaps(
    history: DataFrame, products: DataFrame, competitors: DataFrame, as_of, days: int = 7, ordered: bool = False
) -> DataFrame:
    """Competitor price history beside our current price, with the difference in percent."""
    ours = products.select(
        F.col("sku").alias("product_sku"), "category", F.col("name").alias("product_name"),
        F.col("current_price").alias("our_price"),
    )
    theirs = competitors.select(
        F.col("id").alias("competitor_id"), F.col("code").alias("competitor_name"),
        F.col("name").alias("competitor_full_name"),
    )
    mine = F.col("our_price").cast("double")
    diff = (F.col("price") - F.col("our_price")).cast("double") / F.nullif(mine, F.lit(0.0)) * 100
    rows = (
        history.filter(F.col("data_timestamp") > ago(as_of, days=days))
        .join(ours, "product_sku")
        .join(theirs, "competitor_id")
        .select(
            "competitor_id", "competitor_name", "competitor_full_name", "category", "product_sku", "product_name",
            F.col("price").alias("competitor_price"), "our_price", diff.alias(GAP), "in_stock", "data_timestamp",
        )
    )
    return rows.orderBy(F.col("data_timestamp").desc()) if ordered else rows


def competitor_kpis(gaps: DataFrame, threshold: float = DEFAULTS.undercut_pct) -> DataFrame:
    """Products, mean gap, undercuts, cheaper and pricier shares and aggression per competitor."""
    gap, deep = F.col(GAP), F.col(GAP) <= -threshold
    per = gaps.groupBy("competitor_name").agg(
        F.max("competitor_full_name").alias("competitor_full_name"),
        F.countDistinct("product_sku").alias("products_tracked"),
        F.avg(gap).alias("avg_gap_pct"),
        count_where(deep).alias("undercut_count"),
        F.count(F.lit(1)).alias("n"),
        count_where(gap < 0).alias("cheaper"),
        count_where(gap > 0).alias("pricier"),
        F.coalesce(avg_where(deep, F.abs(gap)), F.lit(0.0)).alias("deep_gap"),
    )
    share = lambda c: F.col(c) / F.col("n")
    return per.select(
        "competitor_name",
        "competitor_full_name",
        "products_tracked",
        "avg_gap_pct",
        "undercut_count",
        (share("undercut_count") * 100).alias("undercut_pct"),
        (share("cheaper") * 100).alias("cheaper_pct"),
        (share("pricier") * 100).alias("pricier_pct"),
        (share("undercut_count") * F.col("deep_gap")).alias("aggression"),
    )


def category_competitor_prices(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("category", "competitor_name").agg(
        exact_avg(F.col("competitor_price")).alias("competitor_avg_price"),
        F.avg(GAP).alias(GAP),
        F.countDistinct("product_sku").alias("product_count"),
    )


def our_category_prices(gaps: DataFrame) -> DataFrame:
    """Our mean price per category, each (category, sku, price) counted once."""
    return (
        gaps.select("category", "product_sku", "our_price")
        .distinct()
        .groupBy("category")
        .agg(exact_avg(F.col("our_price")).alias("our_price"))
    )


def category_price_comparison(gaps: DataFrame) -> DataFrame:
    """Competitor averages with our own stacked below."""
    ours = our_category_prices(gaps).select(
        "category", F.lit("Our Prices").alias("competitor_name"), F.col("our_price").alias("competitor_avg_price")
    )
    return category_competitor_prices(gaps).select("category", "competitor_name", "competitor_avg_price").unionByName(ours)


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """Mean, exact median, extremes, sample deviation and cheaper/dearer shares per competitor."""
    gap = F.col(GAP)
    stats = gaps.groupBy("competitor_name").agg(
        F.avg(gap).alias("mean_diff"),
        F.min(gap).alias("min_diff"),
        F.max(gap).alias("max_diff"),
        F.stddev_samp(gap).alias("std_diff"),
        count_where(gap < 0).alias("cheaper"),
        count_where(gap > 0).alias("dearer"),
        F.count(F.lit(1)).alias("n"),
    )
    share = lambda c: F.col(c) / F.col("n") * 100
    return (
        stats.join(exact_median(gaps, ["competitor_name"], GAP, "median_diff"), "competitor_name", "left")
        .withColumn("cheaper_pct", share("cheaper"))
        .withColumn("dearer_pct", share("dearer"))
        .drop("n")
    )


def gap_histogram(gaps: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(gaps, GAP, bins, by=["competitor_name"])


def top_undercut_products(gaps: DataFrame, threshold: float = DEFAULTS.undercut_pct, n: int = 10) -> DataFrame:
    """Per competitor: the deepest undercut of each product, deepest first."""
    deepest = F.min_by(
        F.struct("product_name", "competitor_price", "our_price", GAP), F.struct(GAP, "data_timestamp")
    ).alias("d")
    per_product = (
        gaps.filter(F.col(GAP) <= -threshold)
        .groupBy("competitor_name", "product_sku")
        .agg(deepest)
        .select("competitor_name", "product_sku", "d.*")
    )
    order = Window.partitionBy("competitor_name").orderBy(GAP, "product_sku")
    return per_product.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def price_history_comparison(gaps: DataFrame, skus: Sequence[str] = (), codes: Sequence[str] = ()) -> DataFrame:
    return gaps.filter(
        in_selection(F.col("product_sku"), skus) & in_selection(F.col("competitor_name"), codes)
    ).select("product_sku", "product_name", "competitor_name", "competitor_price", "our_price", "data_timestamp")
