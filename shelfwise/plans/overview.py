"""Overview reports over signals, market summary, behaviour and demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import (
    arranged,
    ago, avg_where, count_where, exact_avg, in_selection, instant, product_label, seconds_between,
)

# Display name and meaning of each signal type.
SIGNAL_DISPLAY = {
    "UNDERCUT": "Undercut",
    "OVERPRICED": "Overpriced",
    "STOCKOUT": "Stockout",
    "PRICE_INCREASE_24H": "Abrupt Increase",
    "SEQUENTIAL_CHANGE": "Sequential Change",
}
SIGNAL_MEANING = {
    "UNDERCUT": "Competitor has lower price than our platform",
    "OVERPRICED": "Competitor has higher price than our platform",
    "STOCKOUT": "Competitor is out of stock",
    "PRICE_INCREASE_24H": "Abrupt increase from recent minimum",
    "SEQUENTIAL_CHANGE": "Competitor changed price vs previous",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def _is(kind: str) -> Column:
    return F.upper("signal_type") == kind


def _gap() -> Column:
    return F.abs("percentage_diff")


def competitor_stats(
    signals: DataFrame, competitors: DataFrame, as_of, days: int = 30, ordered: bool = False
) -> DataFrame:
    """Signal counts, mean gaps and price aggression per competitor, unknown competitors kept.

    Signals are aggregated before the join, so only one row per competitor is joined.
    """
    per = (
        signals.filter(F.col("signal_timestamp") > ago(as_of, days=days))
        .groupBy("competitor_id")
        .agg(
            F.count(F.lit(1)).alias("signal_count"),
            exact_avg(_gap()).alias("avg_change_pct"),
            count_where(_is("UNDERCUT")).alias("undercuts"),
            count_where(_is("OVERPRICED")).alias("overpriced_count"),
            count_where(_is("PRICE_INCREASE_24H")).alias("price_increase_24h_count"),
            count_where(_is("STOCKOUT")).alias("stockout_count"),
            exact_avg(F.when(_is("UNDERCUT"), _gap())).alias("avg_undercut_pct"),
            exact_avg(F.when(_is("OVERPRICED"), _gap())).alias("avg_overpriced_pct"),
        )
    )
    names = competitors.select(
        F.col("id").alias("competitor_id"),
        F.col("code").alias("competitor_name"),
        F.col("name").alias("competitor_full_name"),
    )
    frequency = F.col("undercuts") / F.nullif(F.col("undercuts") + F.col("overpriced_count"), F.lit(0))
    return (
        per.join(names, "competitor_id", "left")
        .withColumn("decrease_frequency", frequency)
        .withColumn(
            "price_aggression",
            F.coalesce("decrease_frequency", F.lit(0.0)) * F.coalesce("avg_change_pct", F.lit(0.0)),
        )
        .transform(arranged, ordered, F.col("signal_count").desc(), "competitor_id")
    )


def product_stats(signals: DataFrame, products: DataFrame, as_of, days: int = 30, ordered: bool = False) -> DataFrame:
    """Signal counts, competitor price range and volatility per product."""
    per = (
        signals.filter(F.col("signal_timestamp") > ago(as_of, days=days))
        .groupBy("product_sku")
        .agg(
            F.count(F.lit(1)).alias("signal_count"),
            exact_avg(_gap()).alias("avg_change_pct"),
            F.min("competitor_price").alias("min_price"),
            F.max("competitor_price").alias("max_price"),
            F.max("signal_timestamp").alias("last_signal"),
            count_where(_is("UNDERCUT")).alias("undercut_count"),
            count_where(_is("OVERPRICED")).alias("overpriced_count"),
        )
    )
    names = products.select(F.col("sku").alias("product_sku"), F.col("name").alias("product_name"), "category")
    spread = (F.col("max_price") - F.col("min_price")).cast("double")
    return (
        per.join(names, "product_sku")
        .withColumn("price_range", F.col("max_price") - F.col("min_price"))
        .withColumn("price_volatility", spread / F.nullif(F.col("min_price").cast("double"), F.lit(0.0)) * 100)
        .transform(arranged, ordered, F.col("signal_count").desc(), "product_sku")
    )


def enriched_signals(
    signals: DataFrame, products: DataFrame, competitors: DataFrame, as_of, days: int = 7, ordered: bool = False
) -> DataFrame:
    """Recent signals with names, category, display type and meaning; by priority then newest when ordered."""
    names = products.select(F.col("sku").alias("product_sku"), F.col("name").alias("product_name"), "category")
    theirs = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    kind = F.upper("signal_type")
    rows = (
        signals.filter(F.col("signal_timestamp") > ago(as_of, days=days))
        .join(names, "product_sku")
        .join(theirs, "competitor_id")
        .select(
            "product_sku", "product_name", "competitor_id", "competitor_name", "signal_type", "platform_price",
            "competitor_price", "percentage_diff", "recommendation", "priority", "in_stock", "signal_timestamp",
            "category", kind.alias("signal_type_norm"),
            F.coalesce(_lookup(SIGNAL_DISPLAY, kind), F.col("signal_type")).alias("signal_display"),
            _lookup(SIGNAL_MEANING, kind).alias("signal_category"),
        )
    )
    return rows.orderBy("priority", F.col("signal_timestamp").desc()) if ordered else rows


def actionable(enriched: DataFrame) -> DataFrame:
    """Everything but sequential changes."""
    return enriched.filter(F.col("signal_type_norm") != "SEQUENTIAL_CHANGE")


def signal_freshness(signals: DataFrame, as_of) -> DataFrame:
    at = F.col("signal_timestamp")
    return signals.agg(
        F.max(at).alias("last_signal"),
        count_where(at > ago(as_of, hours=1)).alias("signals_1h"),
        count_where(at > ago(as_of, days=1)).alias("signals_24h"),
    ).select(
        "last_signal",
        (seconds_between(instant(as_of), F.col("last_signal")) / 60.0).alias("age_minutes"),
        "signals_1h",
        "signals_24h",
    )


def pipeline_status(
    signals: DataFrame, trends: DataFrame, summary: DataFrame, as_of, settings: Settings = DEFAULTS
) -> DataFrame:
    """OK, STALE or DOWN per pipeline output, by the age of its newest row."""
    parts = [
        ("signals", signals, "signal_timestamp", settings.fresh_signals),
        ("trends", trends, "window_end", settings.fresh_trends),
        ("summary", summary, "summary_timestamp", settings.fresh_summary),
    ]

    def one(name: str, df: DataFrame, col: str, limit: int) -> DataFrame:
        return df.agg(F.max(col).alias("last_seen")).select(
            F.lit(name).alias("pipeline"), "last_seen", F.lit(limit).alias("limit_minutes")
        )

    first, *rest = [one(*p) for p in parts]
    for df in rest:
        first = first.unionByName(df)
    age = seconds_between(instant(as_of), F.col("last_seen")) / 60.0
    status = F.when(age.isNull(), "DOWN").when(age <= F.col("limit_minutes"), "OK").otherwise("STALE")
    return first.select("pipeline", "last_seen", age.alias("age_minutes"), status.alias("status"))


def engagement_delta(summary: DataFrame, as_of) -> DataFrame:
    """Mean search rate of the last hour and day against the hour and day before, in one pass."""
    at, rate = F.col("window_end"), F.col("search_rate")
    h1, h2, d1, d2 = ago(as_of, hours=1), ago(as_of, hours=2), ago(as_of, days=1), ago(as_of, days=2)
    means = summary.filter(at > d2).agg(
        avg_where(at > h1, rate).alias("rate_1h"),
        avg_where((at <= h1) & (at > h2), rate).alias("rate_prev_1h"),
        avg_where(at > d1, rate).alias("rate_24h"),
        avg_where((at <= d1) & (at > d2), rate).alias("rate_prev_24h"),
    )
    return means.select(
        "*",
        (F.col("rate_1h") - F.col("rate_prev_1h")).alias("delta_1h"),
        (F.col("rate_24h") - F.col("rate_prev_24h")).alias("delta_24h"),
    )


def latest_per_sku(dvs: DataFrame) -> DataFrame:
    """Newest window of every sku."""
    rest = [c for c in dvs.columns if c != "product_sku"]
    return (
        dvs.groupBy("product_sku").agg(F.max_by(F.struct(*rest), "window_end").alias("w")).select("product_sku", "w.*")
    )


def top_opportunities(dvs: DataFrame, products: DataFrame, as_of, n: int = 5, days: int = 1) -> DataFrame:
    """Skus with the highest score in their newest window."""
    recent = dvs.filter(F.col("window_end") > ago(as_of, days=days)).select(
        "product_sku", "window_end", "score", "engagement_delta", "undercut_cnt", "price_position"
    )
    best = latest_per_sku(recent).orderBy(F.col("score").desc(), "product_sku").limit(n)
    names = products.select(F.col("sku").alias("product_sku"), "name")
    return best.join(names, "product_sku", "left").select(
        "product_sku",
        product_label(F.col("name"), F.col("product_sku")).alias("label"),
        "score",
        "engagement_delta",
        "undercut_cnt",
        "price_position",
    )


def _kind(kind: str) -> Column:
    return F.col("signal_type_norm") == kind


def signal_kpis(enriched: DataFrame) -> DataFrame:
    """Totals, high-priority share, counts per type and mean gaps of actionable signals."""
    totals = actionable(enriched).agg(
        F.count(F.lit(1)).alias("total_signals"),
        count_where(F.col("priority") == 1).alias("high_priority"),
        count_where(_kind("UNDERCUT")).alias("undercuts"),
        count_where(_kind("OVERPRICED")).alias("overpriced"),
        count_where(_kind("STOCKOUT")).alias("stockouts"),
        count_where(_kind("PRICE_INCREASE_24H")).alias("increases_24h"),
        F.coalesce(exact_avg(F.when(_kind("UNDERCUT"), _gap())), F.lit(0.0)).alias("avg_undercut"),
        F.coalesce(exact_avg(F.when(_kind("OVERPRICED"), _gap())), F.lit(0.0)).alias("avg_overpriced"),
    )
    share = F.coalesce(F.col("high_priority") / F.nullif(F.col("total_signals"), F.lit(0)) * 100, F.lit(0.0))
    return totals.withColumn("high_priority_pct", share)


def market_kpis(summary: DataFrame) -> DataFrame:
    gap = F.col("gap_pct")
    return summary.agg(
        count_where(gap > 0).alias("competitor_cheaper"),
        count_where(gap < 0).alias("we_cheapest"),
        exact_avg(F.when(gap > 0, gap)).alias("avg_gap_undercut"),
        F.avg("competitor_count").alias("avg_competitors"),
    )


def priority_queue(enriched: DataFrame, priority: int, n: int = 5) -> DataFrame:
    return (
        actionable(enriched)
        .filter(F.col("priority") == priority)
        .orderBy(F.col("signal_timestamp").desc(), "product_sku", "competitor_id", "signal_type")
        .limit(n)
    )


def signal_type_counts(enriched: DataFrame) -> DataFrame:
    return (
        actionable(enriched)
        .groupBy("signal_display")
        .agg(F.count(F.lit(1)).alias("signals"))
        .orderBy(F.col("signals").desc(), "signal_display")
    )


def signal_category_counts(enriched: DataFrame) -> DataFrame:
    return actionable(enriched).groupBy("category", "signal_display").agg(F.count(F.lit(1)).alias("signals"))


def market_exposure(summary: DataFrame, competitors: DataFrame, products: DataFrame) -> DataFrame:
    """Market summary with competitor name, product category and label."""
    theirs = competitors.select(
        F.col("id").alias("cheapest_competitor_id"), F.col("name").alias("cheapest_competitor_name")
    )
    names = products.select(F.col("sku").alias("product_sku"), "name", "category")
    return (
        summary.join(theirs, "cheapest_competitor_id", "left")
        .join(names, "product_sku", "left")
        .withColumn("product_label", product_label(F.col("name"), F.col("product_sku")))
        .select(
            "product_sku", "product_label", "category", "cheapest_competitor_name", "cheapest_price",
            "platform_price", "gap_pct", "competitor_count", "in_stock_competitor_count", "summary_timestamp",
        )
    )


def market_leaderboard(
    summary: DataFrame, competitors: DataFrame, products: DataFrame, n: int = 20, undercut_only: bool = False
) -> DataFrame:
    """Products with the widest gap; the cut to ``n`` runs before the name joins."""
    rows = summary.filter(F.col("gap_pct") > 0) if undercut_only else summary
    top = rows.orderBy(F.col("gap_pct").desc_nulls_last(), "product_sku").limit(n)
    return market_exposure(top, competitors, products)


def top_undercutters(enriched: DataFrame, n: int = 5) -> DataFrame:
    return (
        enriched.filter(_kind("UNDERCUT"))
        .groupBy("competitor_name")
        .agg(F.count(F.lit(1)).alias("undercuts"))
        .orderBy(F.col("undercuts").desc(), "competitor_name")
        .limit(n)
    )


def filter_categories(df: DataFrame, products: DataFrame, categories) -> DataFrame:
    """Keep rows of the chosen categories, directly or through the product lookup; no choice keeps all."""
    if not categories:
        return df
    if "category" in df.columns:
        return df.filter(in_selection(F.col("category"), categories))
    allowed = products.filter(in_selection(F.col("category"), categories)).select(F.col("sku").alias("product_sku"))
    return df.join(allowed, "product_sku", "left_semi")


def all_categories(enriched: DataFrame, products: DataFrame) -> DataFrame:
    return (
        enriched.select("category")
        .union(products.select("category"))
        .filter(F.col("category").isNotNull())
        .distinct()
        .orderBy("category")
    )


def trend_snapshot(trends: DataFrame, as_of, days: int = 1) -> DataFrame:
    return trends.filter(F.col("window_end") > ago(as_of, days=days)).select("trend_direction")
