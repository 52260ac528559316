"""Elasticity reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import ago, arranged, count_where, in_selection
from shelfwise.functions.distribution import histogram


def _sellable(products: DataFrame) -> DataFrame:
    return products.filter(F.col("is_active") & F.col("in_stock"))


def sensitivity_history(
    history: DataFrame, products: DataFrame, as_of, days: int = 30, categories: Sequence[str] = (), skus: Sequence[str] = ()
) -> DataFrame:
    """Recent estimates with the name and category of active, in-stock products."""
    names = _sellable(products).select("sku", "name", "category")
    return (
        history.filter(F.col("updated_at") > ago(as_of, days=days))
        .join(names, "sku", "left")
        .filter(in_selection(F.col("category"), categories) & in_selection(F.col("sku"), skus))
    )


def sensitivity_kpis(products: DataFrame) -> DataFrame:
    label = F.col("price_sensitivity")
    return _sellable(products).agg(
        count_where(label.isNotNull()).alias("products_with_sensitivity"),
        count_where(label == "high").alias("high"),
        count_where(label == "medium").alias("medium"),
        count_where(label == "low").alias("low"),
        F.max("sensitivity_last_updated").alias("last_updated"),
    )


def observation_count(observations: DataFrame, products: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (
        observations.filter(F.col("observed_at") > ago(as_of, hours=hours))
        .join(_sellable(products).select("sku"), "sku", "left_semi")
        .agg(F.count(F.lit(1)).alias("observations"))
    )


def elasticity_over_time(history: DataFrame, per_sku: bool = False, ordered: bool = False) -> DataFrame:
    if per_sku:
        rows = history.select("sku", "updated_at", "price_elasticity", "price_sensitivity", "observations")
        return arranged(rows, ordered, "updated_at", "sku")
    rows = history.groupBy("updated_at").agg(F.avg("price_elasticity").alias("price_elasticity"))
    return arranged(rows, ordered, "updated_at")


def elasticity_histogram(history: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(history, "price_elasticity", bins)


def elasticity_by_category(history: DataFrame) -> DataFrame:
    return (
        history.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.avg("price_elasticity").alias("price_elasticity"))
        .orderBy("price_elasticity")
    )


def recent_sensitivity(history: DataFrame, n: int = 500) -> DataFrame:
    order = [F.col("updated_at").desc(), "sku", "price_elasticity", "observations"]
    return history.orderBy(*order).limit(n).select(
        "updated_at", "sku", "name", "category", "price_elasticity", "price_sensitivity", "observations"
    )
