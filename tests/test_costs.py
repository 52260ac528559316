"""What a row costs, read off plans: F11, F13, F14, F17, F19, F21, F23-F25."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from shelfwise.functions import penalised
from shelfwise.operators import forecast, ingest, signals


def method_sizes(df) -> list[int]:
    plan = df._jdf.queryExecution().sparkPlan()
    session = df.sparkSession
    rules = df._jdf.queryExecution().executedPlan() if session.conf.get("spark.sql.adaptive.enabled") == "false" else plan
    found = getattr(session._jvm.org.apache.spark.sql.execution.debug, "package$")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", getattr(found, "MODULE$").codegenString(rules))]


def test_marked_rows_and_their_method(spark):
    """the same rows as by 36 equalities, in a method the JVM compiles (at most 8,000 bytes)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1, 90).select(F.col("id").alias("n")).withColumn("rn", F.explode(F.expr("sequence(1L, n)")))
        marked = rows.repartition(2).filter(penalised._marked())
        assert 0 < max(method_sizes(marked)) < 8000
        got = {(r["n"], r["rn"]) for r in marked.collect()}
        windows = spark.createDataFrame([], "product_sku string, competitor_id long, window_end timestamp, avg_price double, price_volatility double")
        assert 0 < max(method_sizes(forecast.fit_series(windows))) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = set()
    for n in range(1, 90):
        for k in range(6):
            prefix = n - k * (n // 6)
            want |= {(n, prefix - j * (prefix // 6)) for j in range(6)}
    assert got == {(n, rn) for n, rn in want if 1 <= rn <= n}


def ticks(spark):
    rows = [(s, c, datetime(2024, 1, d, 10), float(p), i % 2 == 0) for i, (s, c, d, p) in enumerate(
        (s, c, d, 10 + (7 * d + len(s + c)) % 5) for s in ("a", "b") for c in ("X", "x", "ghost") for d in (1, 2, 3))]
    made = spark.createDataFrame(rows, "product_sku string, competitor_name string, event_time timestamp, price double, in_stock boolean")
    return made.withColumn("price", F.col("price").cast("decimal(10,2)"))


def test_copies_leave_before_the_second_order(spark):
    """F13 and others: the moved copies serve the tail only, so the head is a window over the rows alone, led by a number."""
    found = signals.with_low_24h(ticks(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first, second = [i for i, line in enumerate(plan.split("\n")) if "Window [" in line]
    assert "_head" in plan.split("\n")[first] and "_tail" in plan.split("\n")[second]
    assert any("Filter" in line and "_moved" in line for line in plan.split("\n")[first:second])
    assert "Sort [_hash" in found._jdf.queryExecution().executedPlan().toString()
    rows = ticks(spark).collect()
    want = sorted(
        (r["product_sku"], r["competitor_name"], r["event_time"],
         min(q["price"] for q in rows if q[:2] == r[:2] and 0 <= (r["event_time"] - q["event_time"]).total_seconds() <= 86400))
        for r in rows
    )
    assert sorted(tuple(r) for r in found.select("product_sku", "competitor_name", "event_time", "low_24h").collect()) == want


def test_unknown_competitors_leave_before_the_order(spark):
    """F13 and others: their rows are not dealt; two spellings of one competitor stay two pairs with one result row a rule."""
    products = spark.createDataFrame(
        [("a", 12.0, "high", True, True), ("b", 11.0, None, True, True)],
        "sku string, price double, price_sensitivity string, in_stock boolean, is_active boolean",
    ).withColumn("current_price", F.col("price").cast("decimal(10,2)"))
    competitors = spark.createDataFrame([("x", 7)], "code string, id long")
    found = signals.current_signals(ticks(spark), products, competitors, "2024-01-04 00:00:00")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Window [") < plan.index("LeftSemi")
    plain = signals.newest_per_key(signals.all_signals(ticks(spark), products, competitors, "2024-01-04 00:00:00"))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() > 2


def test_envelopes_are_read_for_what_is_asked(spark):
    """the other map is not built, and a text is read as a time once, not once per use."""
    good = '{"product":{"sku":"s"},"data_sources":{"competitors":{"c":{"price":1.5},"v":{}},"aggregators":{"p":{"available":true}}},"collection_timestamp":"2024-01-01T00:00:00Z"}'
    raw = spark.createDataFrame([(good, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), ("{", datetime(2024, 1, 1))], "value string, ingest_time timestamp")
    quotes, offers = ingest.flatten_competitor_prices(raw), ingest.flatten_aggregator_prices(raw)
    assert "stores_tracked" not in quotes._jdf.queryExecution().optimizedPlan().toString()
    assert "in_stock" not in offers._jdf.queryExecution().optimizedPlan().toString()
    assert quotes._jdf.queryExecution().optimizedPlan().toString().count("try_cast(collection_timestamp") == 1
    assert [tuple(map(str, r)) for r in quotes.collect()] == [("s", "c", "1.50", "None", "None", "1704067200000", "1704067200000")]
    assert [r["aggregator_name"] for r in offers.collect()] == ["p"]
