"""Reports over demand-versus-signals windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import ago, arranged, count_where, in_selection, product_label
from shelfwise.plans.overview import latest_per_sku


def dvs_enriched(
    dvs: DataFrame, products: DataFrame, as_of, days: int = 7, categories: Sequence[str] = (), skus: Sequence[str] = ()
) -> DataFrame:
    """Recent windows with product name, category and label."""
    names = products.select(F.col("sku").alias("product_sku"), "name", "category")
    return (
        dvs.filter(F.col("window_end") > ago(as_of, days=days))
        .join(names, "product_sku", "left")
        .withColumn("product_label", product_label(F.col("name"), F.col("product_sku")))
        .filter(in_selection(F.col("category"), categories) & in_selection(F.col("product_sku"), skus))
    )


def filter_by_competitor_signals(
    dvs: DataFrame, signals: DataFrame, competitor_ids: Sequence[int], as_of, days: int = 7
) -> DataFrame:
    """Windows of skus that have a recent signal from one of the chosen competitors."""
    if not competitor_ids:
        return dvs
    skus = signals.filter(
        (F.col("signal_timestamp") > ago(as_of, days=days)) & F.col("competitor_id").isin(list(competitor_ids))
    ).select("product_sku")
    return dvs.join(skus.distinct(), "product_sku", "left_semi")


def dvs_kpis(dvs: DataFrame) -> DataFrame:
    position = F.col("price_position")
    share = lambda p: count_where(position == p) / F.nullif(F.count(position), F.lit(0)) * 100
    return dvs.agg(
        F.avg("engagement_delta").alias("avg_engagement_delta"),
        F.sum("undercut_cnt").alias("total_undercuts"),
        F.avg("score").alias("avg_score"),
        share("competitor_cheaper").alias("competitor_cheaper_pct"),
        share("we_cheaper").alias("we_cheaper_pct"),
        share("unknown").alias("unknown_pct"),
    )


def score_over_time(dvs: DataFrame) -> DataFrame:
    return dvs.groupBy("window_end").agg(F.avg("score").alias("score")).orderBy("window_end")


def engagement_by_category(dvs: DataFrame) -> DataFrame:
    return (
        dvs.filter(F.col("category").isNotNull())
        .groupBy("category", "window_end")
        .agg(F.avg("engagement_delta").alias("engagement_delta"))
        .orderBy("window_end", "category")
    )


def top_scored(dvs: DataFrame, n: int = 15) -> DataFrame:
    return (
        latest_per_sku(dvs)
        .orderBy(F.col("score").desc(), "product_sku")
        .limit(n)
        .select("product_sku", "product_label", "score", "engagement_delta", "undercut_cnt", "price_position")
    )


def risk_triage(dvs: DataFrame, n: int = 15) -> DataFrame:
    """Newest windows where a competitor is cheaper, largest engagement loss first."""
    return (
        latest_per_sku(dvs)
        .filter(F.col("price_position") == "competitor_cheaper")
        .orderBy("engagement_delta", "product_sku")
        .limit(n)
        .select(
            "product_sku", "product_label", "engagement_delta", "undercut_cnt", "avg_undercut_gap_pct", "score",
            "window_end",
        )
    )


def category_impact(dvs: DataFrame) -> DataFrame:
    return (
        dvs.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.avg("score").alias("score"))
        .orderBy(F.col("score").desc(), "category")
    )


def dvs_details(dvs: DataFrame, ordered: bool = False) -> DataFrame:
    return dvs.select(
        "product_sku", "window_start", "window_end", "engagement_delta", "undercut_cnt", "avg_undercut_gap_pct",
        "avg_abrupt_inc_gap_pct", "avg_overpriced_gap_pct", "price_position", "score",
    ).transform(arranged, ordered, "product_sku", F.col("window_end").desc())
