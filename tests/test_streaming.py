"""Streams over several files give what the batch operators give on the same rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import behavior, demand, market, prices, signals
from shelfwise.sinks.tables import KeyedTable
from shelfwise.sources import streams
from shelfwise.streaming import jobs
from shelfwise.streaming.ordered import stream_low_24h, stream_previous_price

T = 1704067200000
FAR = T + 30 * 86400 * 1000


def write_lines(folder, name, files):
    path = f"{folder}/{name}"
    os.makedirs(path)
    for i, docs in enumerate(files):
        with open(f"{path}/{i:03d}.json", "w") as f:
            f.write("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")
        os.utime(f"{path}/{i:03d}.json", (1_700_000_000 + i * 100,) * 2)
    return path


def quote(sku, shop, cents, seconds, stock=True, i=0, data=True):
    at = T + seconds * 1000
    return {"product_sku": sku, "competitor_name": shop, "price": cents / 100, "in_stock": stock, "source_sku": str(i),
            "api_collection_ts_ms": at + 1000, "data_ts_ms": at if data else None}


SENTINEL = [{**quote("zz", "Amazon", 100, 0), "data_ts_ms": FAR, "api_collection_ts_ms": FAR}]


@pytest.fixture
def price_files():
    rows = [quote("a" if i % 2 else "b", "Amazon", 9000 + (i * 377) % 2500, i * 4000 - (i % 3) * 100, i % 5 != 0, i) for i in range(60)]
    rows += [quote("a", "Amazon", 9100 + i, 4000, True, 900 + i) for i in range(3)]
    return [rows[:30] + ["{broken"], rows[30:], SENTINEL]


def run(stream, spark, folder, mode="append"):
    """All rows a stream emits with what is there now, collected through a keyed batch log."""
    seen = f"{folder}/seen"

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    jobs.start(stream, keep, f"{folder}/checkpoint", trigger=None, mode=mode).awaitTermination()
    return spark.read.parquet(seen)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.filter("product_sku <> 'zz'").select(*cols).collect()), key=str)


def test_trends(spark, folder, price_files):
    path = write_lines(folder, "in", price_files)
    cols = ["product_sku", "competitor_name", "window_start", "avg_price", "price_volatility", "trend_direction"]
    got = run(jobs.stream_price_trends(streams.read_competitor_prices(spark, path, files_per_batch=1)), spark, folder)
    want = prices.price_trends(streams.read_competitor_prices(spark, path, streaming=False))
    assert rows(got, *cols) == rows(want, *cols)


def test_late_rows_are_dropped(spark, folder):
    # a row counts as late against the watermark of the batch before, so one file lies in between
    times = [(100, 0), (100, 7200), (100, 7201), (900, 1)]
    path = write_lines(folder, "in", [[quote("a", "x", cents, at)] for cents, at in times] + [SENTINEL])
    got = run(jobs.stream_price_trends(streams.read_competitor_prices(spark, path, files_per_batch=1)), spark, folder)
    assert [str(r["avg_price"]) for r in got.filter("product_sku = 'a'").orderBy("window_start").collect()] == ["1.00", "1.00"]


def test_starting_position(spark, folder):
    path = write_lines(folder, "in", [[quote("a", "x", 100, 0)], [quote("b", "x", 100, 10)]])
    late = streams.read_competitor_prices(spark, path, streaming=False, starting="latest", started_at="2023-11-14 22:14:00")
    assert [r["product_sku"] for r in late.collect()] == ["b"]
    assert streams.read_competitor_prices(spark, path, streaming=False).count() == 2


def test_previous_price(spark, folder, price_files):
    path = write_lines(folder, "in", price_files)
    cols = ["product_sku", "source_sku", "price", "previous_price"]
    got = run(stream_previous_price(streams.read_competitor_prices(spark, path, files_per_batch=1)), spark, folder)
    batch = streams.read_competitor_prices(spark, path, streaming=False)
    want = signals.ordered_lag(batch, signals.PAIR, "event_time", signals.TIES, "price", "previous_price")
    assert rows(got, *cols) == rows(want, *cols)
    dims = dimension_frames(spark)
    moves = jobs.price_movements_of(got, *dims)
    assert rows(moves, "new_price", "pct_change", "direction") == rows(
        signals.price_movements(batch, dims[0](), dims[1]()), "new_price", "pct_change", "direction"
    )


def dimension_frames(spark):
    shop = spark.createDataFrame([("a", 95.0, "high", True, True), ("b", 100.0, None, True, True)], "sku string, current_price double, price_sensitivity string, in_stock boolean, is_active boolean")
    shop = shop.withColumn("current_price", F.col("current_price").cast("decimal(10,2)"))
    rivals = spark.createDataFrame([(1, "Amazon", "amazon")], "id bigint, name string, code string")
    return (lambda: shop), (lambda: rivals)


def test_low_24h(spark, folder, price_files):
    path = write_lines(folder, "in", price_files)
    cols = ["product_sku", "source_sku", "price", "low_24h"]
    got = run(stream_low_24h(streams.read_competitor_prices(spark, path, files_per_batch=1)), spark, folder)
    batch = streams.read_competitor_prices(spark, path, streaming=False)
    assert rows(got, *cols) == rows(signals.with_low_24h(batch), *cols)
    dims = dimension_frames(spark)
    late = "2024-02-20 00:00:00"
    assert rows(jobs.price_increases_of(got, *dims, late), "competitor_price", "recommendation") == rows(
        signals.price_increase_signals(batch, dims[0](), dims[1](), late), "competitor_price", "recommendation"
    )


def test_latest_and_fan_out(spark, folder, price_files):
    path = write_lines(folder, "in", price_files)
    order = ["event_time", "api_collection_ts_ms", "source_sku", "price"]
    dims = dimension_frames(spark)
    newest = KeyedTable(f"{folder}/latest", signals.PAIR, order)
    found = KeyedTable(f"{folder}/signals", signals.SIGNAL_KEY, ["signal_timestamp", "competitor_price", "in_stock"])
    keep = lambda b: b.select("product_sku", "competitor_name", "price", "in_stock", *[c for c in order if c != "price"])
    outputs = jobs.fan_out(
        [(keep, jobs.upsert_sink(newest)), (lambda b: jobs.row_signals_of(b, *dims), jobs.upsert_sink(found))]
    )
    jobs.start(streams.read_competitor_prices(spark, path, files_per_batch=1), outputs, f"{folder}/cp", trigger=None).awaitTermination()
    batch = streams.read_competitor_prices(spark, path, streaming=False)
    assert rows(newest.read(spark), "product_sku", "price", "event_time") == rows(market.latest_prices(batch), "product_sku", "price", "event_time")
    want = signals.newest_per_key(jobs.row_signals_of(batch, *dims))
    cols = ["product_sku", "signal_type", "competitor_price", "recommendation", "priority"]
    assert rows(found.read(spark), *cols) == rows(want, *cols)
    live = jobs.stream_latest(streams.read_competitor_prices(spark, path), signals.PAIR, order, ["price", "in_stock", "event_time"])
    got = run(live, spark, f"{folder}/live", mode="update")
    assert rows(got, "product_sku", "price") == rows(market.latest_prices(batch), "product_sku", "price")


def visit(sku, seconds, views, found):
    at = T + seconds * 1000
    return {"sku": sku, "page_views": views, "searches": found, "unique_visitors": 1, "cart_additions": 2, "purchases": 1,
            "price_comparisons": 1, "dwell_seconds": 2.5, "api_collection_ts_ms": at, "data_ts_ms": at}


def test_behavior_and_demand(spark, folder):
    visits = [visit("a" if i % 3 else "b", i * 130, 100 + i, (i * 7) % 50) for i in range(60)]
    end = [{**visit("zz", 0, 1, 1), "data_ts_ms": FAR + d, "api_collection_ts_ms": FAR + d} for d in (0, 86400000)]
    path = write_lines(folder, "in", [visits[:30], visits[30:], end[:1], end[1:]])
    batch = behavior.behavior_summary(streams.read_user_behavior(spark, path, streaming=False))
    cols = ["product_sku", "window_start", "page_views", "searches", "search_rate", "avg_dwell_seconds"]
    got = run(jobs.stream_behavior_summary(streams.read_user_behavior(spark, path, files_per_batch=1)), spark, folder)
    assert rows(got, *cols) == rows(batch, *cols)

    signal_rows = [{"product_sku": "a", "signal_type": t, "percentage_diff": g, "signal_timestamp": f"2024-01-01T00:{m:02d}:00Z"}
                   for m, t, g in ((1, "UNDERCUT", 4.5), (7, "OVERPRICED", 6.0), (8, "UNDERCUT", 3.0), (31, "OVERPRICED", 7.0))]
    last = [{"product_sku": "zz", "signal_type": "STOCKOUT", "percentage_diff": 0, "signal_timestamp": f"2024-01-{d}T00:00:00Z"} for d in (30, 31)]
    spath = write_lines(folder, "signals", [signal_rows, last[:1], last[1:]])
    schema = "product_sku string, signal_type string, percentage_diff decimal(5,2), signal_timestamp timestamp"
    timed = lambda df: df.withColumn("event_time", F.col("signal_timestamp"))
    live = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(spath)).withWatermark("event_time", "5 minutes")
    raw = streams.file_records(spark, path, True, 1)
    from shelfwise import schemas

    unmarked = raw.select(F.from_json("value", schemas.USER_BEHAVIOR).alias("d")).select("d.*").withColumn("event_time", F.timestamp_millis("data_ts_ms"))
    got = run(jobs.stream_demand_vs_signals(unmarked, live), spark, f"{folder}/dvs")
    want = demand.demand_vs_signals(batch, timed(spark.read.schema(schema).json(spath)))
    cols = ["product_sku", "window_start", "engagement_delta", "undercut_cnt", "overpriced_cnt", "avg_undercut_gap_pct", "price_position", "score"]
    assert rows(got, *cols) == rows(want, *cols)
