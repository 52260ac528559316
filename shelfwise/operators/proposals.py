"""Price proposals: demand baseline, pricing, run bookkeeping, applying and moderation."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import ago, count_where, instant, price_floor, seconds_between
from shelfwise.operators.forecast import cheapest_reliable_forecast


def pricing_features(products: DataFrame) -> DataFrame:
    """Active, in-stock skus; a missing or zero elasticity counts as -1."""
    return products.filter(F.col("is_active") & F.col("in_stock")).select(
        "sku",
        F.col("current_price").cast("double").alias("price"),
        F.col("cost").cast("double").alias("cost"),
        F.col("min_viable_price").cast("double").alias("min_viable_price"),
        F.coalesce(F.nullif(F.col("price_elasticity").cast("double"), F.lit(0.0)), F.lit(-1.0)).alias("elasticity"),
    )


def demand_baseline(
    summary: DataFrame, as_of, minutes: int = DEFAULTS.demand_minutes, halflife: int = DEFAULTS.ema_halflife_rows
) -> DataFrame:
    """Exponentially smoothed purchases per hour over the recent windows of a sku.

    The recursive average has closed-form weights: ``a (1-a)^k`` for the k-th newest row and
    ``(1-a)^(n-1)`` for the oldest. The look-back bounds a sku to a handful of windows.
    """
    decay = math.exp(-math.log(2.0) / halflife)
    minutes_long = seconds_between(F.col("window_end"), F.col("window_start")) / 60.0
    span = F.coalesce(F.nullif(minutes_long, F.lit(0.0)), F.lit(5.0))
    newest_first = Window.partitionBy("product_sku").orderBy(
        F.col("window_end").desc(), F.col("window_start").desc(), F.col("purchases").desc()
    )
    age = F.row_number().over(newest_first) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("product_sku"))
    weighted = summary.filter(F.col("window_end") > ago(as_of, minutes=minutes)).select(
        "product_sku",
        (F.col("purchases").cast("double") * (F.lit(60.0) / span)).alias("rate"),
        age.alias("age"),
        size.alias("n"),
    )
    lead = F.when(F.col("age") < F.col("n") - 1, F.lit(1.0 - decay)).otherwise(F.lit(1.0))
    level = F.sum(lead * F.pow(F.lit(decay), F.col("age")) * F.col("rate"))
    return weighted.groupBy(F.col("product_sku").alias("sku")).agg(
        F.when(level > 0, level).otherwise(F.lit(1.0)).alias("demand_baseline")
    )


class Outcome(NamedTuple):
    demand_delta: Column
    profit_delta: Column
    profit: Column


def _outcome(candidate: Column) -> Outcome:
    """Constant-elasticity demand and profit of a candidate price against the current one."""
    price, cost, base = F.col("price"), F.col("cost"), F.col("demand_baseline")
    demand = base * F.pow(candidate / price, F.col("elasticity"))
    profit = F.greatest(F.lit(0.0), candidate - cost) * demand
    today = F.greatest(F.lit(0.0), price - cost) * base
    return Outcome(demand - base, profit - today, profit)


def _with_baseline(features: DataFrame) -> DataFrame:
    if "demand_baseline" in features.columns:
        return features.withColumn("demand_baseline", F.coalesce("demand_baseline", F.lit(1.0)))
    return features.withColumn("demand_baseline", F.lit(1.0))


def _floored(candidate: Column, settings: Settings) -> Column:
    return price_floor(candidate, F.col("cost"), F.col("min_viable_price"), settings.min_margin_pct)


def _forecast_choice(settings: Settings) -> Column:
    forecast = F.col("forecast_price")
    target = forecast * F.lit(1.0 - settings.target_undercut_pct)
    candidate = _floored(target, settings)
    result = _outcome(candidate)
    return F.struct(
        F.round(candidate, 2).alias("proposed_price"),
        result.demand_delta.alias("expected_demand_delta"),
        result.profit_delta.alias("expected_profit_delta"),
        ((candidate - forecast) / F.nullif(forecast, F.lit(0.0))).alias("competitor_gap_after"),
        result.profit.alias("score"),
        F.lit("elasticity+forecast").alias("reason_code"),
    )


def _grid_choice(settings: Settings) -> Column:
    """Best of the evenly spaced candidate prices; equal profits keep the lowest step.

    The candidates live in an array of the row, so choosing needs no explode and no shuffle.
    """
    step = 2 * settings.price_grid_pct / (settings.grid_points - 1)

    def option(i: Column) -> Column:
        candidate = _floored(F.col("price") * (F.lit(1.0) + (F.lit(-settings.price_grid_pct) + i * F.lit(step))), settings)
        result = _outcome(candidate)
        return F.struct(
            result.profit.alias("score"),
            (-i).alias("rank"),
            F.round(candidate, 2).alias("proposed_price"),
            result.demand_delta.alias("expected_demand_delta"),
            result.profit_delta.alias("expected_profit_delta"),
        )

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(settings.grid_points - 1)), option))
    return F.struct(
        best["proposed_price"].alias("proposed_price"),
        best["expected_demand_delta"].alias("expected_demand_delta"),
        best["expected_profit_delta"].alias("expected_profit_delta"),
        F.lit(None).cast("double").alias("competitor_gap_after"),
        best["score"].alias("score"),
        F.lit("elasticity-only").alias("reason_code"),
    )


def _proposed(features: DataFrame, choice: Column) -> DataFrame:
    return features.withColumn("_p", choice).select(
        "sku",
        F.round("price", 2).alias("old_price"),
        F.col("elasticity").alias("elasticity_used"),
        "_p.*",
    )


def forecast_proposals(features: DataFrame, cheapest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Undercut the cheapest reliable forecast slightly, never below the floor."""
    anchored = _with_baseline(features).join(cheapest.select("sku", F.col("prediction").alias("forecast_price")), "sku")
    return _proposed(anchored, _forecast_choice(settings))


def grid_proposals(features: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Most profitable price of a small grid around the current one."""
    return _proposed(_with_baseline(features), _grid_choice(settings))


def _constraints(settings: Settings) -> Column:
    anchored = F.to_json(
        F.struct(
            F.lit(settings.min_margin_pct).alias("min_margin_pct"),
            F.lit(settings.target_undercut_pct).alias("target_undercut_pct"),
            F.lit(settings.gap_tolerance_pct).alias("gap_tolerance_pct"),
            F.lit(True).alias("forecast_reliability"),
            F.lit(settings.demand_minutes).alias("demand_baseline_minutes"),
            F.lit(settings.ema_halflife_rows).alias("demand_ema_halflife_minutes"),
        )
    )
    gridded = F.to_json(
        F.struct(
            F.lit(settings.min_margin_pct).alias("min_margin_pct"),
            F.lit(settings.price_grid_pct).alias("price_grid_pct"),
            F.lit(60).alias("demand_baseline_minutes"),
            F.lit(settings.ema_halflife_rows).alias("demand_ema_halflife_minutes"),
        )
    )
    return F.when(F.col("reason_code") == "elasticity+forecast", anchored).otherwise(gridded)


def price_proposals(
    products: DataFrame, summary: DataFrame, forecasts: DataFrame, as_of, run_id: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """One pending proposal per candidate sku: forecast-anchored where a reliable forecast exists, else grid."""
    cheapest = cheapest_reliable_forecast(forecasts).select("sku", F.col("prediction").alias("forecast_price"))
    ready = _with_baseline(
        pricing_features(products).join(demand_baseline(summary, as_of, settings.demand_minutes), "sku", "left")
    ).join(cheapest, "sku", "left")
    choice = F.when(F.col("forecast_price").isNotNull(), _forecast_choice(settings)).otherwise(_grid_choice(settings))
    return _proposed(ready, choice).select(
        "sku",
        F.col("old_price").cast("decimal(10,2)").alias("old_price"),
        F.col("proposed_price").cast("decimal(10,2)").alias("proposed_price"),
        F.col("elasticity_used").try_cast("decimal(6,3)").alias("elasticity_used"),
        "expected_demand_delta",
        "expected_profit_delta",
        F.col("competitor_gap_after").try_cast("decimal(6,2)").alias("competitor_gap_after"),
        "score",
        "reason_code",
        _constraints(settings).alias("constraints"),
        F.lit("pending").alias("status"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        instant(as_of).alias("created_at"),
        F.lit(settings.proposer).alias("created_by"),
    )


def should_run(runs: DataFrame, history: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """One row deciding whether a run is due; it is skipped only when both time and new rows are low."""
    last = runs.agg(F.max("finished_at")).scalar()
    facts = history.agg(count_where(F.col("collection_timestamp") > last).alias("new_rows")).withColumn(
        "last_finished", last
    )
    elapsed = seconds_between(instant(as_of), F.col("last_finished")) / 60.0
    quiet = (F.col("elapsed_min") < settings.guard_minutes) & (F.col("new_rows") < settings.guard_rows)
    return facts.withColumn("elapsed_min", elapsed).select(
        "last_finished",
        "elapsed_min",
        "new_rows",
        (F.col("last_finished").isNull() | ~quiet).alias("run"),
    )


def run_record(
    candidates: DataFrame, proposals: DataFrame, run_id: int, started_at, finished_at, settings: Settings = DEFAULTS
) -> DataFrame:
    """Log row of a finished run."""
    proposed = proposals.agg(F.count(F.lit(1))).scalar()
    return candidates.agg(F.count(F.lit(1)).cast("int").alias("candidates_count")).select(
        F.lit(run_id).cast("bigint").alias("id"),
        instant(started_at).alias("started_at"),
        instant(finished_at).alias("finished_at"),
        F.to_json(F.struct(F.lit(settings.price_grid_pct).alias("price_grid_pct"))).alias("parameters"),
        "candidates_count",
        proposed.cast("int").alias("proposed_count"),
        F.lit(settings.proposer).alias("created_by"),
    )


def apply_candidates(
    proposals: DataFrame, as_of, auto_pending: bool = False, limit: int | None = None
) -> DataFrame:
    """The proposals to apply: effective and unexpired; the ``limit`` with the oldest approval (or creation) when asked for."""
    now = instant(as_of)
    status = F.col("status").isin("approved", "pending") if auto_pending else F.col("status") == "approved"
    live = (F.col("effective_from").isNull() | (F.col("effective_from") <= now)) & (
        F.col("expires_at").isNull() | (F.col("expires_at") > now)
    )
    first = F.col("created_at") if auto_pending else F.col("approved_at")
    chosen = proposals.filter(status & live)
    if limit is not None:
        chosen = chosen.orderBy(first.asc_nulls_last(), "created_at", "id").limit(limit)
    return chosen.select("id", "sku", "old_price", "proposed_price", "reason_code", first.alias("order_ts"), "created_at")


def apply_proposals(products: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcome of every candidate, applied in order with compare-and-set on the old price.

    A later candidate of a sku sees the price an earlier one set; a NULL old price always
    applies. The fold keeps a price and one flag per step; a sku's list holds its open proposals.
    """
    steps = candidates.groupBy("sku").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("order_ts").isNull().alias("undated"),
                    "order_ts",
                    "created_at",
                    "id",
                    "old_price",
                    "proposed_price",
                    "reason_code",
                )
            )
        ).alias("steps")
    )
    start = F.struct(F.col("current_price").alias("price"), F.array().cast("array<boolean>").alias("flags"))

    def advance(state: Column, step: Column) -> Column:
        ok = step["old_price"].isNull() | F.coalesce(step["old_price"] == state["price"], F.lit(False))
        price = F.when(ok, step["proposed_price"]).otherwise(state["price"])
        return F.struct(price.alias("price"), F.concat(state["flags"], F.array(ok)).alias("flags"))

    folded = steps.join(products.select("sku", "current_price"), "sku", "left").withColumn("f", F.aggregate("steps", start, advance))
    each = F.posexplode(F.arrays_zip("steps", F.col("f.flags").alias("flags"))).alias("seq", "t")
    return folded.select("sku", F.col("f.price").alias("final_price"), each).select(
        F.col("t.steps.id").alias("id"),
        "sku",
        "seq",
        F.col("t.steps.old_price").alias("old_price"),
        F.col("t.steps.proposed_price").alias("new_price"),
        F.col("t.steps.reason_code").alias("reason_code"),
        F.when(F.col("t.flags"), "applied").otherwise("rejected_stale").alias("outcome"),
        "final_price",
    )


class Applied(NamedTuple):
    products: DataFrame
    history: DataFrame
    proposals: DataFrame
    counts: DataFrame


def apply_outputs(
    products: DataFrame, proposals: DataFrame, outcomes: DataFrame, as_of, settings: Settings = DEFAULTS
) -> Applied:
    """New product snapshot, price history rows, proposal statuses and outcome counts of an apply run."""
    now = instant(as_of)
    done = outcomes.filter(F.col("outcome") == "applied")
    moved = done.groupBy("sku").agg(F.max_by("new_price", "seq").alias("_new"))
    snapshot = (
        products.join(moved, "sku", "left")
        .withColumn("current_price", F.coalesce("_new", "current_price"))
        .withColumn("updated_at", F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")))
        .select(*products.columns)
    )
    history = done.select(
        "sku",
        "old_price",
        F.col("new_price").alias("adjusted_price"),
        F.lit("proposal_apply").alias("change_type"),
        F.lit(settings.applier).alias("changed_by"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("reason_code"),
        now.alias("change_timestamp"),
        F.col("reason_code").alias("notes"),
        F.col("id").alias("proposal_id"),
    )
    verdict = outcomes.select("id", "outcome")
    rejected = F.col("outcome") == "rejected_stale"
    marked = (
        proposals.join(verdict, "id", "left")
        .withColumn("status", F.when(rejected, "rejected").otherwise(F.coalesce("outcome", "status")))
        .withColumn(
            "notes",
            F.when(rejected, F.concat(F.coalesce("notes", F.lit("")), F.lit(" stale_or_mismatch"))).otherwise(F.col("notes")),
        )
        .withColumn("applied_at", F.when(F.col("outcome").isNotNull(), now).otherwise(F.col("applied_at")))
        .select(*proposals.columns)
    )
    counts = outcomes.agg(
        count_where(F.col("outcome") == "applied").alias("applied"),
        count_where(F.col("outcome") != "applied").alias("rejected"),
    )
    return Applied(snapshot, history, marked, counts)


def moderate(proposals: DataFrame, decisions: DataFrame, as_of, moderator: str = "dashboard") -> DataFrame:
    """Set decided proposals to approved or rejected; approval time is stamped on approvals only."""
    verdict = decisions.select("id", F.col("status").alias("_s"), F.col("note").alias("_n"))
    hit = F.col("_s").isNotNull()
    note = F.when(F.coalesce("_n", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("_n")))
    return (
        proposals.join(verdict, "id", "left")
        .withColumn("status", F.coalesce("_s", "status"))
        .withColumn("approved_at", F.when(F.col("_s") == "approved", instant(as_of)).otherwise(F.col("approved_at")))
        .withColumn("approved_by", F.when(hit, F.coalesce("approved_by", F.lit(moderator))).otherwise(F.col("approved_by")))
        .withColumn("notes", F.when(hit, F.concat(F.coalesce("notes", F.lit("")), note)).otherwise(F.col("notes")))
        .select(*proposals.columns)
    )
