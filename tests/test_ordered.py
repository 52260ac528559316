import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import distribution, ordered
from shelfwise.functions.distribution import exact_median, exact_quantile, histogram

DAY = 86400


@pytest.fixture(scope="module")
def ticks(spark):
    """One key holds a third of all rows; times repeat and sit exactly a day apart."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        at = rng.choice([rng.randrange(0, 4 * DAY), rng.randrange(0, 96) * 3600, 300 * rng.randrange(0, 40)])
        rows.append((key, at, i, rng.randrange(100, 999)))
    return spark.createDataFrame(rows, "k string, s bigint, id bigint, v bigint").withColumn("at", F.timestamp_seconds("s"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seconds", [300, 3600, 10 * DAY])
def test_lag(ticks, seconds):
    want = ticks.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at", "id")))
    got = ordered.ordered_lag(ticks, ["k"], "at", ["id"], "v", "p", seconds)
    assert rows(got, "id", "v", "p") == rows(want, "id", "v", "p")


@pytest.mark.parametrize("seconds", [300, 3600, DAY])
def test_range_min(ticks, seconds):
    day = Window.partitionBy("k").orderBy("s").rangeBetween(-DAY, 0)
    want = ticks.withColumn("low", F.min("v").over(day))
    got = ordered.ordered_range_min(ticks, ["k"], "at", "v", "low", bucket_seconds=seconds)
    assert rows(got, "id", "v", "low") == rows(want, "id", "v", "low")
    assert got.columns == [*ticks.columns, "low"]


def test_one_shuffle_of_the_rows(ticks):
    """Rows and bucket summaries read the same exchange: the input is read once."""
    for got in (ordered.ordered_lag(ticks, ["k"], "at", ["id"], "v", "p"), ordered.ordered_range_min(ticks, ["k"], "at", "v", "low")):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan


def test_day_edges(frame):
    df = frame(
        [("a", "2024-01-01 00:00:00", 5), ("a", "2024-01-02 00:00:00", 9), ("a", "2024-01-02 00:00:01", 8),
         ("b", "2024-01-01 00:00:00", 1), ("b", "2024-01-02 00:00:01", 7)],
        "k string;at timestamp;v bigint",
    )
    got = ordered.ordered_range_min(df, ["k"], "at", "v", "low")
    assert rows(got, "k", "v", "low") == rows(
        frame([("a", 5, 5), ("a", 9, 5), ("a", 8, 8), ("b", 1, 1), ("b", 7, 7)], "k string;v bigint;low bigint"), "k", "v", "low"
    )


@pytest.mark.parametrize("n", [1, 2, 5, 400, 401])
def test_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 1.25, rng.uniform(-20, 20)]) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    s = sorted(values)
    assert exact_median(df, ["g"], "v", "m").first()["m"] == pytest.approx((s[(n - 1) // 2] + s[n // 2]) / 2)


@pytest.mark.parametrize("q", [0.0, 0.013, 0.5, 0.9, 1.0])
def test_quantile_narrows_hot_groups_by_counts(spark, q):
    """One group holds most rows, half of them one value, the rest over wild magnitudes; two rounds are needed."""
    wild = F.when(F.col("id") % 2 == 0, F.lit(3.5)).otherwise(F.pow(F.lit(10.0), (F.col("id") * 7919 % 99991) / 2000.0 - 25))
    df = spark.range(60_000).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("hot").alias("g"), wild.alias("v"))
    found = exact_quantile(df, ["g"], "v", q, "m")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    held = {}
    for r in df.collect():
        held.setdefault(r["g"], []).append(r["v"])
    want = {g: sorted(v)[max(math.ceil(q * len(v)), 1) - 1] for g, v in held.items()}
    assert {r["g"]: r["m"] for r in found.collect()} == want


def test_quantile_rounds_do_not_depend_on_the_limit(spark, monkeypatch):
    values = [random.Random(5).uniform(-9, 9) for _ in range(1)] * 700 + [random.Random(i).gauss(0, 5) for i in range(2300)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    plain = {q: exact_quantile(df, ["g"], "v", q, "m").first()["m"] for q in (0.1, 0.5)}
    monkeypatch.setattr(distribution, "AT_MOST", 5)
    assert {q: exact_quantile(df, ["g"], "v", q, "m").first()["m"] for q in (0.1, 0.5)} == plain


def test_histogram(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [0, 1, 2, 9, 10]] + [("b", 4.0), ("b", 4.0)], "g string, v double")
    got = {(r["g"], r["bin"]): r["rows"] for r in histogram(df, "v", 5, by=["g"]).collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("a", 4): 2, ("b", 0): 2}
    assert sum(r["rows"] for r in histogram(df, "v", 3).collect()) == 7


def test_low_24h_is_one_shuffle_of_the_rows(ticks):
    """Day buckets need no summary of buckets, so no second shuffle and no join."""
    from shelfwise.operators.signals import with_low_24h

    named = ticks.select(F.col("k").alias("product_sku"), F.upper("k").alias("competitor_name"), F.col("at").alias("event_time"), F.col("v").alias("price"))
    plan = with_low_24h(named)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_quantile_of_few_large_groups_moves_no_rows(spark, monkeypatch):
    """rows are not gathered by group to meet their bracket; many groups join as before and give the same."""
    monkeypatch.setattr("shelfwise.functions.distribution.AT_MOST", 50)
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    few = exact_median(df, ["g"], "v", "m")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    found = sorted(map(tuple, few.collect()))
    monkeypatch.setattr("shelfwise.functions.distribution.FEW_GROUPS", 0)
    assert sorted(map(tuple, exact_median(df, ["g"], "v", "m").collect())) == found
