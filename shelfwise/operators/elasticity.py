"""Demand observations and price elasticity per product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import ago, instant, sensitivity_label


def demand_rollup(summary: DataFrame, as_of, minutes: int = DEFAULTS.rollup_minutes) -> DataFrame:
    """Latest window end and purchases per sku over the last ``minutes``."""
    return (
        summary.filter(F.col("window_end") > ago(as_of, minutes=minutes))
        .groupBy("product_sku")
        .agg(
            F.max("window_end").alias("observed_at"),
            F.sum(F.coalesce("purchases", F.lit(0))).cast("bigint").alias("demand"),
        )
    )


def price_as_of(rollup: DataFrame, products: DataFrame, price_history: DataFrame) -> DataFrame:
    """Our price when the observation ended: the last change up to then, else the current price.

    The roll-up has one row per sku, so the range condition rides on an equi-join and the
    last change is a map-side combined ``max_by``, not a correlated lookup.
    """
    active = products.filter("is_active").select(F.col("sku").alias("product_sku"), "current_price")
    changes = price_history.select(
        F.col("sku").alias("product_sku"), "change_timestamp", "adjusted_price"
    )
    upto = (
        changes.join(rollup.select("product_sku", "observed_at"), "product_sku")
        .filter(F.col("change_timestamp") <= F.col("observed_at"))
        .groupBy("product_sku")
        .agg(F.max_by("adjusted_price", F.struct("change_timestamp", "adjusted_price")).alias("changed_price"))
    )
    return (
        rollup.join(active, "product_sku")
        .join(upto, "product_sku", "left")
        .select(
            F.col("product_sku").alias("sku"),
            "observed_at",
            F.coalesce("changed_price", "current_price").alias("price"),
            "demand",
        )
    )


def new_observations(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Candidates with a positive price that are later than anything stored for their sku.

    Being strictly later than the stored maximum also rules out an existing (sku, time) key.
    """
    last = observations.groupBy("sku").agg(F.max("observed_at").alias("last_seen"))
    fresh = F.col("last_seen").isNull() | (F.col("observed_at") > F.col("last_seen"))
    return (
        candidates.filter(F.col("price") > 0)
        .join(last, "sku", "left")
        .filter(fresh)
        .select("sku", "observed_at", "price", F.col("demand").cast("int").alias("demand"))
    )


def price_elasticity(observations: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Log-log demand slope per sku over all observations of the look-back period, sums that combine map-side.

    With ``elasticity_newest`` only that many newest observations of a sku count; the planner
    then cuts each partition to as many rows per sku before the shuffle.
    """
    taken = observations.filter(F.col("observed_at") >= ago(as_of, hours=settings.elasticity_hours))
    if settings.elasticity_newest is not None:
        newest = Window.partitionBy("sku").orderBy(F.col("observed_at").desc(), F.col("price").desc(), F.col("demand").desc())
        taken = taken.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= settings.elasticity_newest)
    log_p, log_d = F.ln(F.col("price").cast("double")), F.ln(F.col("demand").cast("double"))
    fits = (
        taken.filter((F.col("price") > 0) & (F.col("demand") > 0))
        .groupBy("sku")
        .agg(
            F.count(F.lit(1)).cast("int").alias("observations"),
            F.var_pop(log_p).alias("_spread"),
            F.regr_slope(log_d, log_p).alias("price_elasticity"),
        )
    )
    # a price that hardly moved (variance of its log within 1e-8 of zero) carries no slope
    usable = (F.col("observations") >= settings.elasticity_min_obs) & (F.col("_spread") > 1e-8)
    return fits.filter(usable).select("sku", "price_elasticity", "observations")


_SUMS = ("n", "p", "d", "pp", "pd")


def hourly_moments(observations: DataFrame) -> DataFrame:
    """What a slope needs of each sku and hour: rows, sums of ln price and ln demand, of its square and of their product.

    Logs are taken to twelve places as decimals, so sums are exact: they may be added and taken away in any order,
    for years, and no error grows.
    """
    log = lambda c: F.ln(F.col(c).cast("double")).cast("decimal(16,12)")
    logs = observations.filter((F.col("price") > 0) & (F.col("demand") > 0)).select(
        "sku", F.date_trunc("hour", "observed_at").alias("hour"), log("price").alias("_p"), log("demand").alias("_d")
    )
    return logs.groupBy("sku", "hour").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).cast("decimal(38,12)").alias(n) for n, c in (("p", "_p"), ("d", "_d"))],
        *[F.sum(c).cast("decimal(38,24)").alias(n) for n, c in (("pp", F.col("_p") * F.col("_p")), ("pd", F.col("_p") * F.col("_d")))],
    )


def merge_moments(moments: DataFrame, *keys: str) -> DataFrame:
    """Moments with equal keys added up: of batches to an hour (``sku``, ``hour``), or of hours to a window (``sku``)."""
    kinds = dict(moments.dtypes)
    return moments.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in _SUMS])


def slide_moments(window: DataFrame, added: DataFrame, dropped: DataFrame) -> DataFrame:
    """A window's moments per sku moved on: hours (or rows of a part of one) that came in, less those that left.

    Only what changed is read, however long the window is. A sku with no rows left leaves.
    """
    less = dropped.select("sku", *[(-F.col(c)).cast(dict(dropped.dtypes)[c]).alias(c) for c in _SUMS])
    parts = window.select("sku", *_SUMS).unionByName(added.select("sku", *_SUMS)).unionByName(less)
    return merge_moments(parts, "sku").filter(F.col("n") > 0)


def moments_between(hourly: DataFrame, observations: DataFrame, since, until=None) -> DataFrame:
    """Moments per sku of rows in ``[since, until)``: whole hours from the stored sums, the two cut hours from rows.

    ``hourly`` may hold an hour in several rows, one per batch. Both sides take plain ranges of time, which prune days.
    """
    start = instant(since)
    first = F.date_trunc("hour", start)
    first = F.when(first < start, first + F.expr("INTERVAL 1 HOUR")).otherwise(first)
    whole, edges = F.col("hour") >= first, (F.col("observed_at") >= start) & (F.col("observed_at") < first)
    if until is not None:
        end = instant(until)
        last = F.date_trunc("hour", end)
        whole &= F.col("hour") < last
        edges = (F.col("observed_at") >= start) & (F.col("observed_at") < end) & ((F.col("observed_at") < first) | (F.col("observed_at") >= last))
    rows = hourly_moments(observations.filter(edges))
    return merge_moments(hourly.filter(whole).select("sku", *_SUMS).unionByName(rows.select("sku", *_SUMS)), "sku")


def elasticity_of(moments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Slopes per sku from a window's moments, by the rules of ``price_elasticity``."""
    n, p, d, pp, pd = (F.col(c).cast("double") for c in _SUMS)
    spread, together = pp / n - p / n * (p / n), pd / n - p / n * (d / n)
    usable = (F.col("n") >= settings.elasticity_min_obs) & (spread > 1e-8)
    return moments.filter(usable).select("sku", (together / spread).alias("price_elasticity"), F.col("n").cast("int").alias("observations"))


def label_estimates(estimates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    label = sensitivity_label(F.col("price_elasticity"), settings.high_sensitivity, settings.medium_sensitivity)
    return estimates.withColumn("price_sensitivity", label)


def apply_sensitivity(products: DataFrame, estimates: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Product snapshot with the estimates of active skus written in; other rows unchanged."""
    new = label_estimates(estimates, settings).select(
        "sku",
        F.col("price_elasticity").alias("_e"),
        F.col("price_sensitivity").alias("_s"),
        F.col("observations").alias("_n"),
    )
    hit = F.col("_e").isNotNull() & F.col("is_active")
    written = {
        "price_sensitivity": F.col("_s"),
        "price_elasticity": F.col("_e").try_cast("decimal(6,3)"),
        "sensitivity_last_updated": instant(as_of),
        "sensitivity_observations": F.col("_n"),
    }
    updated = products.join(new, "sku", "left").withColumns(
        {c: F.when(hit, v).otherwise(F.col(c)) for c, v in written.items()}
    )
    return updated.select(*products.columns)


def sensitivity_history_rows(products: DataFrame, estimates: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """History rows to append, at full slope precision, for active skus."""
    return (
        label_estimates(estimates, settings)
        .join(products.filter("is_active").select("sku"), "sku", "left_semi")
        .select("sku", "price_elasticity", "price_sensitivity", "observations", instant(as_of).alias("updated_at"))
    )
