"""Competitor price forecasts.

History is reduced to five-minute windows first, so one (sku, competitor) series holds at
most ``days * 288`` rows however many records it had. The penalised fit is columns too
(``functions/penalised.py``): one shuffle by series, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import ago, exact_avg, finite_or_null, instant, tumbling
from shelfwise.functions import penalised

SERIES = ["product_sku", "competitor_id"]
MAX_SPLITS = penalised.SPLITS


def history_windows(history: DataFrame, as_of, days: int = DEFAULTS.forecast_days, minutes: int = 5) -> DataFrame:
    """Average and sample deviation of price per series and collection-time window."""
    recent = history.filter(F.col("collection_timestamp") > ago(as_of, days=days))
    return (
        recent.groupBy(*SERIES, tumbling(F.col("collection_timestamp"), f"{minutes} minutes").alias("w"))
        .agg(exact_avg(F.col("price")).alias("avg_price"), F.stddev_samp("price").alias("price_volatility"))
        .select(
            *SERIES,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "avg_price",
            "price_volatility",
        )
    )


def recent_competitors(history: DataFrame, as_of, days: int = 60) -> DataFrame:
    return (
        history.filter(F.col("collection_timestamp") > ago(as_of, days=days)).select(*SERIES).distinct()
    )


def _series_features(windows: DataFrame, horizon: int) -> DataFrame:
    by_time = Window.partitionBy(*SERIES).orderBy("window_end")
    return windows.select(
        *SERIES,
        "window_end",
        "avg_price",
        F.coalesce("price_volatility", F.lit(0.0)).alias("price_volatility"),
        F.lag("avg_price").over(by_time).alias("lag_1"),
        F.lead("avg_price", horizon).over(by_time).alias("target"),
    )


def forecast_features(windows: DataFrame, horizon: int = 1) -> DataFrame:
    """Previous average, volatility and the average ``horizon`` windows ahead; complete rows only."""
    return _series_features(windows, horizon).filter(F.col("lag_1").isNotNull() & F.col("target").isNotNull())


def naive_forecast(windows: DataFrame, horizon: int = 1, min_rows: int = DEFAULTS.forecast_min_rows) -> DataFrame:
    """Last average price for series with too few complete rows to fit a model."""
    complete = F.greatest(F.count(F.lit(1)) - 1 - horizon, F.lit(0)).cast("int")
    last = F.max_by("avg_price", "window_end")
    return (
        windows.groupBy(*SERIES)
        .agg(last.alias("_last"), complete.alias("n_samples"))
        .filter(F.col("n_samples") < min_rows)
        .select(
            F.col("product_sku").alias("sku"),
            "competitor_id",
            F.lit(horizon).alias("horizon"),
            F.round("_last", 2).alias("prediction"),
            F.round("_last", 2).alias("last_price"),
            "n_samples",
            F.lit(False).alias("reliable"),
        )
    )


def cv_folds(features: DataFrame, min_rows: int = DEFAULTS.forecast_min_rows) -> DataFrame:
    """Expanding-window folds: one row per (series, fold) with train length and test bounds.

    Test blocks are the last ``n // (splits + 1)`` rows each, in time order; everything
    before a block trains it.
    """
    sized = features.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    splits = F.greatest(F.lit(2), F.least(F.lit(MAX_SPLITS), F.col("n") - 1)).cast("int")
    test = F.floor(F.col("n") / (F.col("splits") + 1))
    start = F.col("n") - (F.col("splits") - F.col("fold") + 1) * F.col("test_rows")
    return (
        sized.withColumn("splits", splits)
        .withColumn("test_rows", test)
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("splits"))))
        .select(
            *SERIES,
            F.col("n").cast("int").alias("n_samples"),
            "splits",
            "fold",
            start.cast("int").alias("train_rows"),
            (start + F.col("test_rows")).cast("int").alias("test_end"),
        )
    )


def baseline_mae(features: DataFrame, min_rows: int = DEFAULTS.forecast_min_rows) -> DataFrame:
    """Mean absolute error of repeating the last training target, per series over its folds."""
    by_time = Window.partitionBy(*SERIES).orderBy("window_end")
    numbered = features.select(*SERIES, "target", F.row_number().over(by_time).alias("rn"))
    # a training part shorter than the inner folds need cannot be fitted; its fold counts nowhere
    folds = cv_folds(features, min_rows).filter(F.col("train_rows") > F.col("splits"))
    tested = numbered.join(folds, SERIES).filter(
        (F.col("rn") >= F.col("train_rows")) & (F.col("rn") <= F.col("test_end"))
    )
    last_train = F.max(F.when(F.col("rn") == F.col("train_rows"), F.col("target"))).over(
        Window.partitionBy(*SERIES, "fold")
    )
    errors = tested.withColumn("_base", last_train).filter(F.col("rn") > F.col("train_rows"))
    per_fold = errors.groupBy(*SERIES, "fold", "n_samples").agg(F.avg(F.abs(F.col("target") - F.col("_base"))).alias("mae"))
    return per_fold.groupBy(*SERIES, "n_samples").agg(F.avg("mae").alias("baseline_mae"))


def score_reliability(forecasts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Confidence from the error against the baseline, and the reliability verdict.

    A zero or missing error on either side leaves the confidence NULL, which is unreliable.
    """
    usable = (F.coalesce("cv_mae", F.lit(0.0)) != 0) & (F.coalesce("baseline_mae", F.lit(0.0)) != 0)
    raw = F.when(
        usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("cv_mae") / F.col("baseline_mae")))
    )
    scored = forecasts.withColumn("confidence", raw)
    good = (F.col("cv_mae") <= settings.mae_limit) & (F.col("confidence") >= settings.confidence_floor)
    return scored.withColumn("reliable", F.coalesce(good, F.lit(False)))


def fit_series(windows: DataFrame, settings: Settings = DEFAULTS, horizon: int = 1) -> DataFrame:
    """Prediction and cross-validated errors per series; too few complete rows repeat the last average, errors NULL."""
    # a series costs the same 1,080 small solutions however few bytes it has, so its tasks are not merged by size
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = _series_features(windows.repartition(tasks, *SERIES), horizon)
    whole = F.col("lag_1").isNotNull() & F.col("target").isNotNull()
    newest = F.max_by(F.struct("avg_price", "price_volatility"), "window_end").alias("now")
    known = series.groupBy(*SERIES).agg(newest, F.count(F.when(whole, F.lit(1))).cast("int").alias("n_samples"))
    rows = penalised.numbered(
        series.filter(whole).select(
            *SERIES, "window_end", F.col("lag_1").alias("x1"), F.col("price_volatility").alias("x2"), F.col("target").alias("y")
        ),
        SERIES,
        "window_end",
    ).filter(F.col("n") >= settings.forecast_min_rows)
    models = penalised.evaluated(rows, SERIES)
    last = F.col("now.avg_price")
    ahead = penalised.predicted("fit", last, F.col("now.price_volatility"))
    fitted = F.col("fit").isNotNull()
    moved = F.when(fitted, F.col("prediction") - last)
    return (
        known.join(models, SERIES, "left")
        .withColumn("prediction", F.when(fitted, ahead).otherwise(last))
        .select(
            F.col("product_sku").alias("sku"), "competitor_id", F.lit(horizon).alias("horizon"), "prediction",
            last.alias("last_price"), "n_samples", F.col("fit.alpha").alias("alpha"), "cv_mae", "cv_rmse", "cv_r2", "baseline_mae",
            moved.alias("pred_diff"), F.when(last > 0, moved / last).when(fitted, 0.0).alias("pred_diff_pct"),
        )
    )


def forecast_competitor_prices(
    history: DataFrame, as_of, settings: Settings = DEFAULTS, horizon: int = 1, minutes: int = 5
) -> DataFrame:
    """Next-step forecast per (sku, competitor) with its cross-validated quality."""
    windows = history_windows(history, as_of, settings.forecast_days, minutes)
    fitted = fit_series(windows, settings, horizon)
    digits = {
        "prediction": 2, "last_price": 2, "alpha": 4, "cv_mae": 4, "cv_rmse": 4, "cv_r2": 3,
        "baseline_mae": 4, "confidence": 4, "pred_diff": 4, "pred_diff_pct": 4,
    }
    scored = score_reliability(fitted, settings)
    # first to nine places: a value halfway between two results is not decided by the last bit of a sum
    rounded = {c: F.round(F.round(finite_or_null(F.col(c)), 9), d) for c, d in digits.items()}
    return scored.withColumns(rounded).select(
        "sku", "competitor_id", "horizon", "prediction", "last_price", "n_samples", "alpha", "cv_mae", "cv_rmse",
        "cv_r2", "baseline_mae", "confidence", "reliable", "pred_diff", "pred_diff_pct",
    )


def cheapest_reliable_forecast(forecasts: DataFrame) -> DataFrame:
    """Lowest reliable prediction per sku; equal predictions fall to the lowest competitor id."""
    return (
        forecasts.filter(F.col("reliable") & F.col("prediction").isNotNull())
        .groupBy("sku")
        .agg(F.min_by(F.struct("competitor_id", "prediction"), F.struct("prediction", "competitor_id")).alias("f"))
        .select("sku", "f.*")
    )


def forecast_metrics(forecasts: DataFrame, run_id: int, as_of) -> DataFrame:
    """Metric rows to store: modelled series of skus that have at least one reliable forecast."""
    trusted = forecasts.filter(F.col("reliable") & F.col("prediction").isNotNull()).select("sku").distinct()
    numbers = [
        "prediction", "last_price", "alpha", "cv_mae", "cv_rmse", "cv_r2", "baseline_mae", "confidence",
        "pred_diff", "pred_diff_pct",
    ]
    kept = forecasts.filter(
        (F.coalesce("n_samples", F.lit(0)) > 0) & F.col("sku").isNotNull() & F.col("competitor_id").isNotNull()
    ).join(trusted, "sku", "left_semi")
    cleaned = kept.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in numbers})
    return cleaned.select(
        F.lit(run_id).alias("run_id"), "sku", "competitor_id", "horizon", "prediction", "last_price", "n_samples",
        "alpha", "cv_mae", "cv_rmse", "cv_r2", "baseline_mae", "confidence", "reliable", "pred_diff",
        "pred_diff_pct", instant(as_of).alias("created_at"),
    )
