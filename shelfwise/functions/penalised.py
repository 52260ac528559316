"""Cross-validated penalised fit of two features, for all series at once, in columns.

A series is rows numbered in time with features ``x1``, ``x2`` and a target ``y``. Training parts are prefixes, so running
sums at a few marked rows give every part's moments; with two features the minimum of ``|y - b - xw|^2 / 2n + alpha |w|_1``
has a closed form per sign pattern. Nothing iterates, nothing has a tolerance to converge to, and every step after the first
shuffle keeps its partitioning by series.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 5
ALPHAS = [10 ** (-3 + 4 * i / 29) for i in range(30)]
VALUES = ("x1", "x2", "y")
PRODUCTS = [f"{a}_{b}" for a, b in combinations_with_replacement(VALUES, 2)]
SUMS = [*VALUES, *PRODUCTS]


def numbered(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows with their number ``rn`` in time, the series' length ``n`` and running sums, about the series' first row."""
    by_time = Window.partitionBy(*keys).orderBy(time)
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        "*",
        F.row_number().over(by_time).cast("bigint").alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"),
        *[F.first(c).over(upto).alias(f"{c}_0") for c in VALUES],
    )
    off = {c: F.col(c) - F.col(f"{c}_0") for c in VALUES}
    terms = {**off, **{p: off[p.split("_")[0]] * off[p.split("_")[1]] for p in PRODUCTS}}
    return placed.select("*", F.struct(*[F.sum(v).over(upto).alias(c) for c, v in terms.items()]).alias("sums"))


def _marked() -> Column:
    """Whether a row ends a part: a prefix that outer folds train on, or one that its inner folds train or test on.

    One remainder per prefix: 36 equalities made a method that is too long for the JVM to compile.
    """
    step = f"(n div {SPLITS + 1})"
    ends = []
    for k in range(SPLITS + 1):
        left = f" - {k} * {step}" if k else ""
        before, part = f"(n - rn{left})", f"((n{left}) div {SPLITS + 1})"
        ends.append(f"({before} between 0 and {SPLITS} * {part} and {before} % greatest({part}, 1) = 0)")
    return F.expr(" or ".join(ends))


def _moment(part: str, count: str, c: str) -> str:
    return f"{part}.{c} / {count}"


def _spread(part: str, count: str, a: str, b: str) -> str:
    """Covariance of two values over a part."""
    return f"({_moment(part, count, f'{a}_{b}')} - {_moment(part, count, a)} * ({_moment(part, count, b)}))"


def _problem(part: str, count: str) -> dict[str, str]:
    """Gram matrix and correlations of a part's centred features, in the prefix's scale."""
    return {
        "g11": f"{_spread(part, count, 'x1', 'x1')} / (d1 * d1)",
        "g12": f"{_spread(part, count, 'x1', 'x2')} / (d1 * d2)",
        "g22": f"{_spread(part, count, 'x2', 'x2')} / (d2 * d2)",
        "c1": f"{_spread(part, count, 'x1', 'y')} / d1",
        "c2": f"{_spread(part, count, 'x2', 'y')} / d2",
    }


SIGNS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def _weights(df: DataFrame) -> DataFrame:
    """``v1`` and ``v2``, the weights that cost least at ``alpha`` among the valid ones of: nothing, one feature alone, both
    under each sign pattern. Each step names what the next one uses, so no term is written or computed twice."""
    det = "g11 * g22 - g12 * g12"
    steps = df.withColumn("_det", F.expr(f"case when {det} > 1e-12D * greatest(g11 * g22, 1e-300D) then {det} end"))
    alone = {f"_a{i}": F.expr(f"case when g{i}{i} > 1e-15D then signum(c{i}) * greatest(abs(c{i}) - alpha, 0D) / g{i}{i} end") for i in (1, 2)}
    pairs = {}
    for i, (s, t) in enumerate(SIGNS):
        pairs[f"_u{i}"] = F.expr(f"(g22 * (c1 - ({s}D) * alpha) - g12 * (c2 - ({t}D) * alpha)) / _det")
        pairs[f"_v{i}"] = F.expr(f"(g11 * (c2 - ({t}D) * alpha) - g12 * (c1 - ({s}D) * alpha)) / _det")
    steps = steps.withColumns({**alone, **pairs})
    fits = " ".join(f"when _u{i} * ({s}D) > 0 and _v{i} * ({t}D) > 0 then _{{w}}{i}" for i, (s, t) in enumerate(SIGNS))
    # of the patterns with both features one at most is valid, but for rounding
    steps = steps.withColumns({"_b1": F.expr(f"case {fits.format(w='u')} end"), "_b2": F.expr(f"case {fits.format(w='v')} end")})
    steps = steps.withColumns(
        {
            "_cost1": F.expr("0.5D * g11 * _a1 * _a1 - c1 * _a1 + alpha * abs(_a1)"),
            "_cost2": F.expr("0.5D * g22 * _a2 * _a2 - c2 * _a2 + alpha * abs(_a2)"),
            "_cost3": F.expr(
                "0.5D * (g11 * _b1 * _b1 + g22 * _b2 * _b2) + g12 * _b1 * _b2 - c1 * _b1 - c2 * _b2 + alpha * (abs(_b1) + abs(_b2))"
            ),
        }
    )
    steps = steps.withColumn("_least", F.expr("least(0D, _cost1, _cost2, _cost3)"))  # passes over NULLs
    choose = "case when _least = 0 then 0D when _cost1 = _least then {0} when _cost2 = _least then {1} else {2} end"
    chosen = {"v1": F.expr(choose.format("_a1", "0D", "_b1")), "v2": F.expr(choose.format("0D", "_a2", "_b2"))}
    return steps.withColumns(chosen).select(*df.columns, "v1", "v2")


def prefix_fits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A ``fit`` (struct) per series and prefix: ``k`` = 0 all rows, 1..5 what the k-th last outer fold trains on.

    ``alpha`` has the least mean squared error over the prefix's own expanding folds, of equals the strongest. Prefixes too
    short for their folds have no row. ``y_last`` is the last target of the prefix.
    """
    marks = rows.filter(_marked()).groupBy(*keys, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("rn", F.struct("sums", "y")))).alias("at"),
        *[F.first(f"{c}_0").alias(f"{c}_0") for c in VALUES],
    )
    first = [f"{c}_0" for c in VALUES]
    prefixes = (
        marks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SPLITS))))
        .withColumn("size", F.expr(f"n - k * (n div {SPLITS + 1})"))
        .filter(F.col("size") > SPLITS)
        .withColumn("step", F.expr(f"size div {SPLITS + 1}"))
        .withColumn("whole", F.expr("element_at(at, size).sums"))
        .withColumn("y_last", F.expr("element_at(at, size).y"))
    )
    for i in ("1", "2"):
        sd = F.expr(f"sqrt(greatest({_spread('whole', 'size', 'x' + i, 'x' + i)}, 0D))")
        prefixes = prefixes.withColumn(f"d{i}", F.when(sd < 1e-9, 1.0).otherwise(sd))
    kept = [*keys, "k", "j", "y_last", "d1", "d2", *first]
    tested = {c: F.expr(f"(end.{c} - train.{c}) / step") for c in SUMS}
    # j = 0 is the prefix itself, 1..5 its inner folds: the last fit of every penalty comes out of the same pass
    parts = (
        prefixes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SPLITS))))
        .withColumn("trained", F.expr("size - j * step"))
        .withColumn("train", F.expr("element_at(at, trained).sums"))
        .withColumn("end", F.expr("case when j > 0 then element_at(at, trained + step).sums end"))
        .select(
            *kept,
            *[F.expr(v).alias(c) for c, v in _problem("train", "trained").items()],
            *[F.expr(_moment("train", "trained", c)).alias(f"m_{c}") for c in VALUES],
            *[v.alias(f"t_{c}") for c, v in tested.items()],
        )
        .withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    )
    solved = _weights(parts).withColumns({"w1": F.expr("v1 / d1"), "w2": F.expr("v2 / d2")})
    solved = solved.withColumn("b", F.expr("m_y - w1 * m_x1 - w2 * m_x2"))
    error = (
        "t_y_y + w1 * w1 * t_x1_x1 + w2 * w2 * t_x2_x2 + 2D * w1 * w2 * t_x1_x2 - 2D * w1 * t_x1_y - 2D * w2 * t_x2_y"
        " - 2D * b * (t_y - w1 * t_x1 - w2 * t_x2) + b * b"
    )
    tried = solved.withColumn("error", F.expr(error))
    # one sum per fold, added in a fixed order: penalties that fit alike tie exactly
    fold = [F.sum(F.when(F.col("j") == j, F.col("error"))) for j in range(1, SPLITS + 1)]
    own = [F.max(F.when(F.col("j") == 0, F.col(c))).alias(c) for c in ("w1", "w2", "b", "y_last", *first)]
    scored = tried.groupBy(*keys, "k", "alpha").agg(sum(fold[1:], fold[0]).alias("error"), *own)
    fit = F.struct("alpha", "w1", "w2", "b", "y_last", *first)
    best = scored.groupBy(*keys, "k").agg(F.min_by(fit, F.struct(F.col("error"), -F.col("alpha"))).alias("fit"))
    return best.select(*keys, "k", "fit")


def predicted(fit: str, x1: Column, x2: Column) -> Column:
    """What a fit (a struct column) says for features."""
    f = lambda c: F.col(f"{fit}.{c}")
    return f("y_0") + (f("b") + f("w1") * (x1 - f("x1_0")) + f("w2") * (x2 - f("x2_0")))


def evaluated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fit of all rows per series (``fit``) with its errors over the outer folds, each tested on the rows after it.

    Errors are means over folds: ``cv_mae``, ``cv_rmse``, ``cv_r2`` (NULL for folds of one row) and ``baseline_mae``, the
    error of repeating the last target of the training part.
    """
    fits = F.map_from_entries(F.collect_list(F.struct("k", "fit"))).alias("fits")
    of_series = prefix_fits(rows, keys).groupBy(*keys).agg(fits)
    block = F.expr(f"(n - rn) div greatest(n div {SPLITS + 1}, 1) + 1").cast("int")
    tested = (
        rows.select(*keys, "x1", "x2", "y", F.least(block, F.lit(SPLITS + 1)).alias("k"))
        .join(of_series, list(keys))
        .withColumn("fit", F.element_at("fits", F.col("k")))
    )
    # rows before the first fold have no fit and count nowhere
    off = tested.select(
        *keys, "k", "y", F.element_at("fits", F.lit(0)).alias("whole"),
        (F.col("y") - predicted("fit", F.col("x1"), F.col("x2"))).alias("off"),
        (F.col("y") - F.col("fit.y_last")).alias("still"),
    )
    squares, total, held = F.sum(F.col("off") * F.col("off")), F.var_pop("y") * F.count("y"), F.count("off")
    flat = F.when(squares == 0, 1.0).otherwise(0.0)
    by_fold = off.groupBy(*keys, "k").agg(
        F.first("whole").alias("fit"),
        F.avg(F.abs("off")).alias("mae"),
        F.sqrt(squares / held).alias("rmse"),
        F.when(held > 1, F.when(total == 0, flat).otherwise(1 - squares / total)).alias("r2"),
        F.avg(F.abs("still")).alias("base"),
    )
    return by_fold.groupBy(*keys).agg(
        F.first("fit").alias("fit"),
        F.avg("mae").alias("cv_mae"),
        F.avg("rmse").alias("cv_rmse"),
        F.avg("r2").alias("cv_r2"),
        F.avg("base").alias("baseline_mae"),
    )
