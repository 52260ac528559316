"""Reports over proposals, runs, price changes and forecast quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import ago, arranged, count_where, in_selection, instant
from shelfwise.operators.forecast import history_windows

PARAMETER_KEYS = ("price_grid_pct", "target_undercut_pct", "gap_tolerance_pct")


def _newest(df: DataFrame, ts: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(n)


def search_proposals(
    proposals: DataFrame, statuses: Sequence[str] = (), since=None, pattern: str | None = None, n: int | None = None
) -> DataFrame:
    """Proposals by status, creation time and a case-insensitive part of the sku; the newest ``n`` when asked for."""
    kept = proposals.filter(in_selection(F.col("status"), statuses))
    if since is not None:
        kept = kept.filter(F.col("created_at") >= instant(since))
    if pattern:
        kept = kept.filter(F.col("sku").ilike(f"%{pattern.strip()}%"))
    return _newest(kept, "created_at", n).select(
        "id", "sku", "status", "created_at", "approved_at", "applied_at", "old_price", "proposed_price",
        "elasticity_used", "expected_profit_delta", "expected_demand_delta", "competitor_gap_after", "score",
        "reason_code",
    )


def recent_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs, the newest ``n`` when asked for, with the known parameters written as ``k=v``; unreadable parameters stay as they are."""
    parsed = F.from_json("parameters", "map<string,string>")
    known = F.array(*[F.lit(k) for k in PARAMETER_KEYS])
    present = F.filter(known, lambda k: F.map_contains_key(parsed, k))
    shown = F.array_join(F.transform(present, lambda k: F.concat(k, F.lit("="), F.try_element_at(parsed, k))), ", ")
    return _newest(runs, "started_at", n).select(
        "id", "started_at", "finished_at", "candidates_count", "proposed_count", "created_by",
        F.when(parsed.isNotNull(), shown).otherwise(F.col("parameters")).alias("params"),
    )


def recent_price_changes(price_history: DataFrame, as_of, hours: int = 24, ordered: bool = False) -> DataFrame:
    return (
        price_history.filter(F.col("change_timestamp") >= ago(as_of, hours=hours))
        .select("sku", "old_price", "adjusted_price", "change_type", "changed_by", "change_timestamp", "proposal_id")
        .transform(arranged, ordered, F.col("change_timestamp").desc(), "proposal_id")
    )


def proposal_kpis(proposals: DataFrame, runs: DataFrame, price_history: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Counts by status and reason, mean deltas, the newest run's proposals and recent changes, as one row."""
    last_run = runs.agg(F.max_by("proposed_count", F.struct("started_at", "id"))).scalar()
    applied = price_history.agg(count_where(F.col("change_timestamp") >= ago(as_of, hours=hours))).scalar()
    is_status = lambda s: count_where(F.col("status") == s)
    is_reason = lambda r: count_where(F.col("reason_code") == r)
    return (
        proposals.agg(
            is_status("pending").alias("pending"),
            is_status("approved").alias("approved"),
            is_reason("elasticity+forecast").alias("forecast_guided"),
            is_reason("elasticity-only").alias("elasticity_only"),
            F.avg("expected_profit_delta").alias("avg_profit_delta"),
            F.avg("expected_demand_delta").alias("avg_demand_delta"),
        )
        .withColumn("last_run_proposals", F.coalesce(last_run, F.lit(0)))
        .withColumn("applied_recently", F.coalesce(applied, F.lit(0)))
    )


def scored_metrics(metrics: DataFrame, since=None) -> DataFrame:
    """Metrics of forecasts that had samples, of all time or since a given instant."""
    scored = metrics.filter(F.col("n_samples") > 0)
    return scored if since is None else scored.filter(F.col("created_at") >= instant(since))


def _improvement(mae: Column, base: Column) -> Column:
    return F.lit(1.0) - mae / F.nullif(base, F.lit(0.0))


def forecast_kpis(metrics: DataFrame) -> DataFrame:
    """Rows, mean errors and mean improvement over the baseline of reliable forecasts."""
    return metrics.filter("reliable").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("cv_mae").alias("mean_cv_mae"),
        F.avg("baseline_mae").alias("mean_baseline_mae"),
        F.avg(_improvement(F.col("cv_mae"), F.col("baseline_mae"))).alias("avg_improvement"),
    )


def _forecast_by(metrics: DataFrame, key: str) -> DataFrame:
    per = metrics.filter("reliable").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("cv_mae").alias("cv_mae"), F.avg("baseline_mae").alias("baseline_mae")
    )
    return per.withColumn("improvement", _improvement(F.col("cv_mae"), F.col("baseline_mae")) * 100).orderBy(
        F.col("improvement").desc(), key
    )


def forecast_by_sku(metrics: DataFrame) -> DataFrame:
    return _forecast_by(metrics, "sku")


def forecast_by_competitor(metrics: DataFrame) -> DataFrame:
    return _forecast_by(metrics, "competitor_id")


def mae_by_sku(metrics: DataFrame, horizon: int = 1, ordered: bool = False) -> DataFrame:
    per = (
        metrics.filter((F.col("horizon") == horizon) & (F.col("n_samples") > 0) & F.col("reliable"))
        .groupBy("sku")
        .agg(F.avg("cv_mae").alias("mean_cv_mae"), F.avg("baseline_mae").alias("mean_baseline_mae"))
    )
    gain = _improvement(F.col("mean_cv_mae"), F.col("mean_baseline_mae")) * 100
    return arranged(per.withColumn("improvement_pct", gain), ordered, "sku")


def mae_by_sku_long(metrics: DataFrame, horizon: int = 1) -> DataFrame:
    """Both mean errors as (sku, metric, value) rows."""
    return mae_by_sku(metrics, horizon).unpivot(
        ["sku"], ["mean_cv_mae", "mean_baseline_mae"], "metric", "value"
    )


STEP = 15 * 60


def _grid(as_of, days: int) -> tuple[Column, Column]:
    """First and last point of the 15-minute grid that begins ``days`` before ``as_of``."""
    start, end = F.unix_seconds(ago(as_of, days=days)), F.unix_seconds(instant(as_of))
    return ago(as_of, days=days), F.timestamp_seconds(start + F.floor((end - start) / STEP) * STEP)


def platform_price_steps(price_history: DataFrame, products: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Our price as intervals of grid points (``ts_from``, ``ts_to``, both included), one row per change of a sku.

    Changes first shrink to the last one of each grid step, so the window over a sku sees at most
    one row per step however often its price changed. The first interval holds the current price.
    """
    start, last = _grid(as_of, days)
    micros = F.unix_micros("change_timestamp") - F.unix_micros(start)
    slot = F.timestamp_micros(F.unix_micros(start) + F.ceil(micros / (STEP * 1e6)) * (STEP * 1_000_000))
    points = (
        price_history.filter((F.col("change_timestamp") > start) & (F.col("change_timestamp") <= instant(as_of)))
        .groupBy("sku", slot.alias("ts_from"))
        .agg(F.max_by("adjusted_price", F.struct("change_timestamp", "proposal_id")).alias("adjusted_price"))
        .filter(F.col("adjusted_price").isNotNull() & (F.col("ts_from") <= last))
        .join(products.select("sku"), "sku", "left_semi")
    )
    seeds = products.select("sku", start.alias("ts_from"), F.col("current_price").alias("adjusted_price"))
    following = F.lead("ts_from").over(Window.partitionBy("sku").orderBy("ts_from"))
    until = F.coalesce(following - F.expr(f"interval {STEP} seconds"), last)
    return seeds.unionByName(points).select("sku", "ts_from", until.alias("ts_to"), "adjusted_price")


def platform_price_series(
    price_history: DataFrame, products: DataFrame, as_of, days: int = 7, skus: Sequence[str] = ()
) -> DataFrame:
    """The price steps of the chosen skus (or of all) spelled out on the 15-minute grid, with no shuffle of the grid."""
    chosen = products.filter(in_selection(F.col("sku"), skus))
    steps = platform_price_steps(price_history, chosen, as_of, days)
    each = F.explode(F.sequence("ts_from", "ts_to", F.expr(f"interval {STEP} seconds"))).alias("ts")
    return steps.select("sku", each, "adjusted_price")


def platform_price_bounds(products: DataFrame, as_of, days: int = 7) -> DataFrame:
    """First and last point of every sku's price series, without building it."""
    start, last = _grid(as_of, days)
    return products.select("sku", start.alias("first"), last.alias("last"))


def competitor_price_series(history: DataFrame, competitors: DataFrame, as_of, days: int = 7, n: int = 3) -> DataFrame:
    """Window averages of the ``n`` competitors seen most recently per sku."""
    windows = history_windows(history, as_of, days).select(
        "product_sku", "competitor_id", F.col("window_start").alias("ts"), "avg_price"
    )
    seen = windows.groupBy("product_sku", "competitor_id").agg(F.max("ts").alias("last_ts"))
    rank = Window.partitionBy("product_sku").orderBy(F.col("last_ts").desc(), "competitor_id")
    chosen = (
        seen.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= n).select("product_sku", "competitor_id")
    )
    codes = competitors.select(F.col("id").alias("competitor_id"), "code")
    return (
        windows.join(chosen, ["product_sku", "competitor_id"], "left_semi")
        .join(codes, "competitor_id", "left")
        .select(
            F.col("product_sku").alias("sku"),
            "competitor_id",
            F.coalesce("code", F.col("competitor_id").cast("string")).alias("series"),
            "ts",
            "avg_price",
        )
    )


def _timed(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn("ts", F.coalesce("effective_from", "created_at"))


def proposal_points(proposals: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Approved proposals of each sku, or all of its proposals where none is approved."""
    recent = _timed(proposals).filter(F.col("created_at") > ago(as_of, days=days))
    approved = recent.groupBy("sku").agg(F.max(F.col("status") == "approved").alias("any_approved"))
    return (
        recent.join(approved, "sku")
        .filter((F.col("status") == "approved") | ~F.col("any_approved"))
        .select("id", "sku", "ts", F.col("proposed_price").alias("price"), "status")
    )


def proposal_steps(proposals: DataFrame, as_of, days: int = 7, ends: DataFrame | None = None) -> DataFrame:
    """Step points per sku closed by a point at the range end that repeats the last price.

    ``ends`` gives the range end per sku (``sku, domain_end``); without it the range ends at ``as_of``.
    """
    points = proposal_points(proposals, as_of, days)
    last = points.groupBy("sku").agg(F.max_by(F.struct("price", "status"), F.struct("ts", "id")).alias("p"))
    if ends is None:
        closing = last.select("sku", instant(as_of).alias("ts"), "p.price", "p.status")
    else:
        closing = last.join(ends.select("sku", "domain_end"), "sku", "left").select(
            "sku", F.coalesce("domain_end", instant(as_of)).alias("ts"), "p.price", "p.status"
        )
    return points.select("sku", "ts", "price", "status", F.lit(False).alias("closing")).unionByName(
        closing.withColumn("closing", F.lit(True))
    )


def upcoming_proposals(proposals: DataFrame, as_of) -> DataFrame:
    """Approved proposals that take effect from five minutes ago on."""
    return (
        _timed(proposals)
        .filter((F.col("status") == "approved") & (F.col("ts") >= ago(as_of, minutes=5)))
        .select("id", "sku", "ts", "old_price", "proposed_price", "status")
    )


def series_overlap(bounds: DataFrame, competitors: DataFrame, points: DataFrame) -> DataFrame:
    """Common time range of our series (its ``platform_price_bounds``) and theirs per sku, stretched to the last proposal.

    Ranges that do not overlap are dropped; a missing side leaves the other's range.
    """
    ours = bounds.select("sku", F.col("first").alias("our_min"), F.col("last").alias("our_max"))
    theirs = competitors.groupBy("sku").agg(F.min("ts").alias("their_min"), F.max("ts").alias("their_max"))
    last = points.groupBy("sku").agg(F.max("ts").alias("last_proposal"))
    joined = ours.join(theirs, "sku", "full").join(last, "sku", "full")
    both = F.col("our_min").isNotNull() & F.col("their_min").isNotNull()
    start, end = F.greatest("our_min", "their_min"), F.least("our_max", "their_max")
    valid = ~both | (start < end)
    stretched = F.greatest(F.col("_end"), F.col("last_proposal"))
    return joined.withColumn("domain_start", F.when(valid, start)).withColumn("_end", F.when(valid, end)).select(
        "sku", "domain_start", stretched.alias("domain_end")
    )


def adjusted_skus(proposals: DataFrame, price_history: DataFrame, as_of, hours: int = 24, ordered: bool = False) -> DataFrame:
    changed = price_history.filter(F.col("change_timestamp") >= ago(as_of, hours=hours)).select("sku")
    return arranged(proposals.select("sku").union(changed).distinct(), ordered, "sku")
