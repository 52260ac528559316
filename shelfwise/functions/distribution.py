"""Histograms and exact medians that send little more than their result through a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the minimum and maximum of each group; empty bins are left out.

    The bounds come from one small aggregate; rows are then binned map-side, so a task sends one
    row per group and bin at most.
    """
    values = _values(df, by, value)
    bounds = F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("_b")
    if by:
        ranged = values.join(values.groupBy(*by).agg(bounds), list(by))
    else:
        ranged = values.withColumn("_b", values.agg(bounds).scalar())
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    slot = F.least(F.floor((F.col("_v") - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    binned = ranged.withColumn("bin", F.when(hi > lo, slot).otherwise(0).cast("int"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (
        binned.groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.first(lo).alias("_lo"), F.first(hi).alias("_hi"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            "rows",
        )
    )


ACCURACY = 10_000
CELLS = 1_000
SHRINK = CELLS / 4  # a round keeps three cells and the summaries' error of a bracket's rows
AT_MOST = 10_000
FEW_GROUPS = 10_000


def _narrowed(values: DataFrame, bracket: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Each group's bracket drawn closer around its ranks, from mergeable quantile summaries and counts.

    A bracket is ``_lo`` and ``_hi``, values between which the rows of ranks ``_first`` and ``_last`` lie, ``_below`` the
    rows under ``_lo``. Its rows' summary tells the cells the ranks fall in; a cell more on either side covers the
    summary's error. A bracket of ``AT_MOST`` rows or fewer stays.
    """
    grid = F.expr("array(" + ", ".join(f"{i / CELLS}D" for i in range(CELLS + 1)) + ")")
    summed = _inside(values, bracket, by, small).groupBy(*by).agg(
        F.percentile_approx("_v", grid, ACCURACY).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        *[F.first(c).alias(c) for c in ("_lo", "_hi", "_below", "_first", "_last")],
    )
    cell = lambda rank: F.floor((F.col(rank) - F.col("_below")) / F.col("_n") * CELLS).cast("int")
    left, right, few = cell("_first") - 1, cell("_last") + 2, F.col("_n") <= AT_MOST
    edges = summed.select(
        *by,
        "_first",
        "_last",
        F.when(few | (left <= 0), F.col("_lo")).otherwise(F.col("_q")[F.greatest(left, F.lit(0))]).alias("_lo"),
        F.when(few | (right >= CELLS), F.col("_hi")).otherwise(F.col("_q")[F.least(right, F.lit(CELLS))]).alias("_hi"),
    )
    under = F.count(F.when(F.col("_v") < F.col("_lo"), F.lit(1)))
    below = _beside(values, edges, by, small).groupBy(*by).agg(under.alias("_below"))
    return edges.join(below, list(by))


def _beside(values: DataFrame, bracket: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    """Rows beside their group's bracket. The brackets of few groups travel to the rows: a few large groups of rows would
    meet in a few tasks."""
    return values.join(F.broadcast(bracket) if small else bracket, list(by))


def _inside(values: DataFrame, bracket: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    return _beside(values, bracket, by, small).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _at_ranks(df: DataFrame, by: Sequence[str], value: str, first: Column, last: Column) -> DataFrame:
    """The values at two neighbouring ranks (expressions of the row count ``_total``) per group, as ``_a`` and ``_b``.

    No group is ranked or sorted: a bracket around the ranks is narrowed until it holds ``AT_MOST`` rows beside repeats
    of its two ends. How many rounds that takes follows from the largest group's size; that and the number of groups are all the driver reads.
    Only counts of the different values in the last bracket meet in a row, so repeated values cost nothing.
    """
    values = _values(df, by, value)
    sizes = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    largest, groups = sizes.agg(F.coalesce(F.max("_total"), F.lit(1)), F.count(F.lit(1))).first()
    small = groups <= FEW_GROUPS
    bracket = sizes.select(
        *by, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), first.cast("bigint").alias("_first"), last.cast("bigint").alias("_last")
    )
    for _ in range(max(0, math.ceil(math.log(largest / AT_MOST, SHRINK)))):
        bracket = _narrowed(values, bracket, by, small)
    counts = _inside(values, bracket, by, small).groupBy(*by, "_v", "_first", "_last", "_below").agg(F.count(F.lit(1)).alias("_n"))
    steps = counts.groupBy(*by, "_first", "_last", "_below").agg(
        F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("_steps")
    )
    unknown = F.lit(None).cast("double")
    start = F.struct(F.col("_below").alias("upto"), unknown.alias("a"), unknown.alias("b"))

    def advance(state: Column, step: Column) -> Column:
        before = state["upto"]
        return F.struct(
            (before + step["_n"]).alias("upto"),
            F.when(before < F.col("_first"), step["_v"]).otherwise(state["a"]).alias("a"),
            F.when(before < F.col("_last"), step["_v"]).otherwise(state["b"]).alias("b"),
        )

    found = steps.withColumn("_f", F.aggregate("_steps", start, advance))
    return found.select(*by, F.col("_f.a").alias("_a"), F.col("_f.b").alias("_b"))


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """The value of rank ``ceil(q * n)`` (1 at least) of each group, NULLs left out."""
    rank = F.greatest(F.ceil(F.col("_total") * F.lit(q)), F.lit(1))
    return _at_ranks(df, by, value, rank, rank).select(*by, F.col("_a").alias(out))


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group; the mean of the two middle values of an even number of rows."""
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return _at_ranks(df, by, value, low, high).select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out))
