"""Signal triage and drill-down reports over enriched signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import arranged, count_where, exact_avg, in_selection, product_label
from shelfwise.plans.overview import actionable

TRIAGE_COLUMNS = [
    "signal_timestamp", "product_name", "product_sku", "category", "competitor_name", "signal_display", "priority",
    "platform_price", "competitor_price", "percentage_diff", "recommendation",
]


def _undercut() -> Column:
    return F.col("signal_type_norm") == "UNDERCUT"


def _gap() -> Column:
    return F.abs("percentage_diff")


def select_signals(
    enriched: DataFrame,
    categories: Sequence[str] = (),
    competitors: Sequence[str] = (),
    displays: Sequence[str] = (),
    priorities: Sequence[int] = (),
    min_gap: float = 0.0,
) -> DataFrame:
    """Actionable signals passing every given filter; an empty filter keeps all."""
    kept = actionable(enriched).filter(
        in_selection(F.col("category"), categories)
        & in_selection(F.col("competitor_name"), competitors)
        & in_selection(F.col("signal_display"), displays)
        & in_selection(F.col("priority"), priorities)
    )
    return kept.filter(_gap() >= min_gap) if min_gap > 0 else kept


def triage(enriched: DataFrame, ordered: bool = False, **filters) -> DataFrame:
    """The filtered action queue; newest first when ordered."""
    rows = select_signals(enriched, **filters).select(*TRIAGE_COLUMNS)
    return arranged(rows, ordered, F.col("signal_timestamp").desc())


def signal_page_kpis(enriched: DataFrame) -> DataFrame:
    """Totals, affected products and products undercut at least twice.

    Signals fold to one row per sku first, so the distinct count needs no second shuffle of
    the signals.
    """
    is_over = F.col("signal_type_norm") == "OVERPRICED"
    per_sku = actionable(enriched).groupBy("product_sku").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("priority") == 1).alias("high"),
        count_where(_undercut()).alias("under"),
        F.sum(F.when(_undercut(), _gap())).alias("under_gap"),
        count_where(is_over).alias("over"),
        F.sum(F.when(is_over, _gap())).alias("over_gap"),
    )
    mean = lambda total, n: F.coalesce(
        F.sum(total).cast("double") / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)
    )
    return per_sku.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_signals"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_priority"),
        F.coalesce(F.sum("high") / F.nullif(F.sum("n"), F.lit(0)) * 100, F.lit(0.0)).alias("high_priority_pct"),
        mean("under_gap", "under").alias("avg_undercut_gap"),
        mean("over_gap", "over").alias("avg_overpriced_gap"),
        F.count(F.lit(1)).alias("products_affected"),
        count_where(F.col("under") >= 2).alias("repeat_undercut_products"),
    )


def signals_by_competitor(enriched: DataFrame, n: int = 20) -> DataFrame:
    return (
        actionable(enriched)
        .groupBy("competitor_name")
        .agg(F.count(F.lit(1)).alias("signals"))
        .orderBy(F.col("signals").desc(), "competitor_name")
        .limit(n)
    )


def signals_per_hour(enriched: DataFrame) -> DataFrame:
    """Signals per hour between the first and the last; hours without any count zero."""
    counts = actionable(enriched).groupBy(F.date_trunc("hour", "signal_timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("signals")
    )
    # reading the counts as well keeps both uses of them on one shuffle
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.sum("signals").alias("n")).filter("n > 0")
    hours = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("signals", F.lit(0)).alias("signals")).orderBy("hour")


def _newest(enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in enriched.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("signal_timestamp", "signal_type")).alias("s")
    return enriched.groupBy(*keys).agg(newest).select(*keys, "s.*").select(*enriched.columns)


def latest_signal_per_competitor(enriched: DataFrame, ordered: bool = False) -> DataFrame:
    """Newest signal of each competitor per product, with our price; cheapest competitor first when ordered."""
    return (
        _newest(actionable(enriched), ["product_sku", "competitor_id"])
        .select(
            "product_sku", "product_name", "competitor_id", "competitor_name", "competitor_price", "platform_price",
            "signal_display", "signal_timestamp",
        )
        .transform(arranged, ordered, "product_sku", "competitor_price", "competitor_id")
    )


def competitor_aggression(enriched: DataFrame) -> DataFrame:
    """Undercut share of all signals times the mean undercut gap, per competitor."""
    per = actionable(enriched).groupBy("competitor_name").agg(
        F.count(F.lit(1)).alias("signals"),
        count_where(_undercut()).alias("undercuts"),
        F.coalesce(exact_avg(F.when(_undercut(), _gap())), F.lit(0.0)).alias("avg_gap"),
    )
    # all columns are read on both sides, so the total reuses the shuffle of the per-competitor rows
    totals = per.agg(F.struct(F.sum("signals").alias("n"), F.sum("undercuts"), F.max("avg_gap"))).scalar()
    share = F.col("undercuts") / F.greatest(F.lit(1), totals["n"])
    return per.select("competitor_name", "signals", "undercuts", (share * F.col("avg_gap")).alias("aggression"))


def top_affected_products(enriched: DataFrame, n: int = 20) -> DataFrame:
    """Per competitor: newest signal of each product, the widest gaps first."""
    by_gap = Window.partitionBy("competitor_name").orderBy(_gap().desc(), "product_sku")
    return (
        _newest(actionable(enriched), ["competitor_name", "product_sku"])
        .withColumn("rank", F.row_number().over(by_gap))
        .filter(F.col("rank") <= n)
        .select(
            "competitor_name",
            "rank",
            "product_sku",
            product_label(F.col("product_name"), F.col("product_sku")).alias("product_label"),
            "percentage_diff",
            "signal_display",
        )
    )


def competitor_signal_mix(enriched: DataFrame) -> DataFrame:
    return actionable(enriched).groupBy("competitor_name", "signal_display").agg(F.count(F.lit(1)).alias("signals"))


def product_signal_history(enriched: DataFrame, sku: str | None = None, ordered: bool = False) -> DataFrame:
    """Signals of one product (or of each); newest first when ordered."""
    rows = actionable(enriched)
    rows = rows if sku is None else rows.filter(F.col("product_sku") == sku)
    return rows.select(
        "product_sku", "signal_timestamp", "competitor_name", "signal_display", "competitor_price", "percentage_diff",
        "priority", "recommendation",
    ).transform(arranged, ordered, "product_sku", F.col("signal_timestamp").desc())
