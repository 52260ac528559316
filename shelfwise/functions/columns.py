"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def instant(as_of: str | datetime | Column) -> Column:
    """A timestamp literal (session zone) from text, a naive datetime, or a column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def ago(as_of: str | datetime | Column, *, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """``as_of`` moved back; folds to a constant so it reaches the scan as a pushed filter."""
    back = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))
    return instant(as_of) - back


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def pct_of(part: Column, base: Column) -> Column:
    """``part / base * 100``; decimal inputs keep decimal scale rules, a zero base gives NULL."""
    return part / F.nullif(base, F.lit(0)) * F.lit(100)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def exact_avg(value: Column) -> Column:
    """Average of a decimal column from its exact sum, as a double (no order-dependent rounding)."""
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def avg_where(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def tumbling(ts: Column, width: str = "5 minutes") -> Column:
    return F.window(ts, width)


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that ``ts`` falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def by_sensitivity(sensitivity: Column, high, medium, other) -> Column:
    """Pick one of three values by sensitivity label; low and NULL share the last one."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (
        F.when(sensitivity == "high", as_col(high))
        .when(sensitivity == "medium", as_col(medium))
        .otherwise(as_col(other))
    )


def signal_priority(sensitivity: Column, high: int, medium: int, other: int) -> Column:
    return by_sensitivity(sensitivity, high, medium, other).cast("smallint")


def sensitivity_label(elasticity: Column, high: float = -1.0, medium: float = -0.3) -> Column:
    return F.when(elasticity <= high, "high").when(elasticity <= medium, "medium").otherwise("low")


def price_floor(candidate: Column, cost: Column, min_viable: Column, min_margin_pct: float) -> Column:
    """Lift a candidate price to the margin floor and, where one is set, the minimum viable price."""
    return F.greatest(candidate, cost * F.lit(1.0 + min_margin_pct), min_viable)


def product_label(name: Column, sku: Column) -> Column:
    return F.coalesce(F.concat(name, F.lit(" ("), sku, F.lit(")")), sku)


def finite_or_null(value: Column) -> Column:
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def in_selection(col: Column, values) -> Column:
    """Membership in a user selection; an empty or missing selection keeps every row."""
    return col.isin(list(values)) if values else F.lit(True)


def arranged(df: DataFrame, ordered: bool, *order) -> DataFrame:
    """``df`` sorted when asked for; a full sort is the reader's wish, not part of a report."""
    return df.orderBy(*order) if ordered else df
