"""Streams that hold a large table at once: rows fold in running aggregates, or wait in few pieces of state."""

import random
import tempfile
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from shelfwise.operators import prices
from shelfwise.sources import streams
from shelfwise.streaming import jobs, updating
from shelfwise.streaming.ordered import KEY, ROW, PricedBuckets, PricedPairs
from tests.test_streaming import SENTINEL, price_files, quote, rows, run, write_lines  # noqa: F401
from tests.test_streaming_state import fire, started


def in_python(df):
    return "TransformWithState" in df._jdf.queryExecution().analyzed().toString()


def test_newest_changes_fold(spark, folder):
    """changes of a row in any order; two batches, the older one last."""
    change = lambda key, op, s, after: {"source": "t", "row_key": key, "op": op, "op_ts": f"2024-01-01T00:00:{s:02d}Z", "after": after}
    path = write_lines(folder, "in", [[change("a", "c", 5, "new"), change("a", "u", 3, "old"), change("b", "d", 9, None)], [change("a", "u", 4, "late"), change("b", "u", 9, "x")]])
    stream = updating.stream_newest_changes(streams.read_table_changes(spark, path, files_per_batch=1))
    assert not in_python(stream)
    seen = run(stream, spark, folder, mode="update").groupBy("row_key").agg(F.max(F.struct("at", "rank", "after")).alias("r")).select("row_key", "r.rank", "r.after")
    assert sorted(map(tuple, seen.collect())) == [("a", 0, "new"), ("b", 2, None)]


def test_rows_of_many_minutes_wait_as_one_chunk():
    """calls into the state per batch and pair, not per row."""
    processor, handle = started(PricedPairs())
    many = [(i * 600_000_000, i, str(i), 1000 + i % 7, True) for i in range(400)]
    random.Random(1).shuffle(many)
    list(processor.handleInputRows(("a", "x"), iter([pd.DataFrame(many, columns=ROW)]), None))
    assert len(handle.states["pending"]) == 1 and len(handle.timers) == 1
    first = fire(processor, handle, ("a", "x"), 399 * 600_000)
    assert first["at"].tolist() == [i * 600_000_000 for i in range(399)] and len(handle.states["pending"]) == 1
    last = fire(processor, handle, ("a", "x"), 400 * 600_000)
    assert last["at"].tolist() == [399 * 600_000_000] and last["previous"].tolist() == [1000 + 398 % 7]
    assert not handle.states["pending"] and not handle.states["parts"]


def test_a_bucket_answers_all_its_pairs_at_once():
    """calls into the state per bucket and batch, not per pair; the rows are those of one processor per pair."""
    rng = random.Random(2)
    pairs = [(sku, shop) for sku in ("a", "b", None) for shop in ("x", "y")] + [(f"s{i}", "x") for i in range(200)]
    batches, start = [], 0
    for k in range(4):
        batch = []
        for p, (sku, shop) in enumerate(pairs):
            for _ in range(rng.choice([0, 1, 30] if p < 6 else [0, 1])):
                at = start + rng.randrange(40) * 3_600_000_000 + rng.choice([0, 1])
                batch.append((p % 2, sku, shop, at, rng.choice([None, 5]), rng.choice([None, "u", "v"]), rng.choice([900, 1000, 1100]), rng.choice([None, True, False])))
        rng.shuffle(batch)
        batches.append(batch)
        start += 20 * 3_600_000_000
    columns = ["slot", *KEY, *ROW]
    frame = lambda rows: pd.DataFrame(rows, columns=columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else v
    table = lambda df: sorted((tuple(map(plain, r)) for r in df[[*KEY, *ROW, "previous", "low"]].itertuples(index=False)), key=str) if len(df) else []
    bucket, handle = started(PricedBuckets())
    single = {p: started(PricedPairs()) for p in pairs}
    seen = 0
    for k, batch in enumerate(batches):
        watermark = (k + 1) * 20 * 3_600_000 if k < 3 else 10**12
        list(bucket.handleInputRows((7,), iter([frame(batch[:50]), frame(batch[50:])] if batch[50:] else [frame(batch)]), None))
        assert k or len(handle.states["pending"]) == 1
        got = fire(bucket, handle, (7,), watermark)
        want = []
        for p, (one, own) in single.items():
            mine = frame([r for r in batch if r[1:3] == p])[ROW]
            if len(mine):
                list(one.handleInputRows(p, iter([mine]), None))
            want += table(fire(one, own, p, watermark))
        assert table(got) == sorted(want, key=str)
        seen += len(got)
    assert seen == sum(map(len, batches)) > 500 and not handle.states["pending"] and not handle.states["parts"] and not handle.timers
    assert handle.states["pending"].read <= 4 * 10 and len(handle.states["memory"]) == 2


def test_a_price_that_is_missing():
    """nulls among the prices; the lowest price passes over them, the previous price does not."""
    bucket, handle = started(PricedBuckets())
    rows = [(0, "a", "x", s * 1_000_000, s, "s", cents, True) for s, cents in ((1, None), (2, 500), (3, None), (4, 700))]
    for part, watermark in ((rows[:3], 3_500), (rows[3:], 10_000)):
        list(bucket.handleInputRows((0,), iter([pd.DataFrame(part, columns=["slot", *KEY, *ROW])]), None))
        out = fire(bucket, handle, (0,), watermark)
        known = [tuple(None if v is pd.NA else v for v in r) for r in out[["cents", "previous", "low"]].itertuples(index=False)]
        assert known == ([(None, None, None), (500, None, 500), (None, 500, 500)] if watermark == 3_500 else [(700, None, 500)])


def test_history_beside_trends_fold(spark, folder, price_files):  # noqa: F811
    """both outputs of one read equal the batch operators, from records that repeat a data time over two batches."""
    price_files[1] += [{**quote("a", "Amazon", 7000 + i, 4000, True, 950 + i), "api_collection_ts_ms": 5} for i in range(2)]
    price_files[0] += [quote("b", "Amazon", 8000 + i, 30 + i, True, i, data=False) for i in range(3)]
    path = write_lines(folder, "in", price_files)
    stream = updating.stream_history_beside_trends(streams.read_competitor_prices(spark, path, files_per_batch=1))
    assert not in_python(stream)
    got = run(stream, spark, folder)
    batch = streams.read_competitor_prices(spark, path, streaming=False)
    cols = ["product_sku", "competitor_name", "window_start", "window_end", "avg_price", "price_volatility", "trend_direction"]
    assert rows(updating.trends_of(got), *cols) == rows(prices.price_trends(batch), *cols)
    cols = ["product_sku", "competitor_name", "price", "in_stock", "source_sku"]
    assert rows(updating.history_of(got), *cols) == rows(prices.dedup_prices(batch), *cols)


def test_a_batch_for_several_outputs_is_kept_in_files(spark, folder, price_files):  # noqa: F811
    """nothing of a batch stays with the executors, one batch's files at a time; a price that is null opens its window."""
    price_files[0] += [{**quote("c", "Amazon", 7000, 30), "price": None}, quote("c", "Amazon", 7100, 40), quote("c", "Amazon", 7200, 30)]
    path = write_lines(folder, "in", price_files)
    rivals = lambda: spark.createDataFrame([(1, "amazon")], "id bigint, code string")
    table, held = jobs.trends_table(f"{folder}/trends"), []
    kept = type(spark.range(0)).persist
    try:
        type(spark.range(0)).persist = lambda df, *a: held.append(df) or kept(df, *a)
        read = streams.read_competitor_prices(spark, path, files_per_batch=1)
        jobs.history_and_trends_job(read, rivals, f"{folder}/history", table, f"{folder}/cp", trigger=None).awaitTermination()
    finally:
        type(spark.range(0)).persist = kept
    assert not held and "newest" in spark.read.parquet(f"{folder}/cp/rows").columns
    cols = ["product_sku", "competitor_name", "window_start", "window_end", "avg_price", "price_volatility", "trend_direction"]
    batch = streams.read_competitor_prices(spark, path, streaming=False)
    assert rows(table.read(spark), *cols) == rows(prices.price_trends(batch), *cols)
    cols = ["product_sku", "competitor_id", "price", "in_stock", "source_sku", "data_timestamp", "collection_timestamp"]
    assert rows(spark.read.parquet(f"{folder}/history"), *cols) == rows(prices.competitor_price_history(batch, rivals()), *cols)


def test_a_window_without_prices(spark, folder):
    """a window whose prices are all null ended the job; it has a trend without figures."""
    path = write_lines(folder, "in", [[{**quote("a", "x", 100, s), "price": None} for s in (1, 2)]])
    given = updating.stream_history_beside_trends(streams.read_competitor_prices(spark, path, streaming=False))
    assert [tuple(r)[4:] for r in updating.trends_of(given).collect()] == [(None, None, "stable")]


def test_state_and_shuffles_of_trends_are_narrow(spark):
    """times as distances in the state, and trends shuffled once on their way to the table."""
    stream = updating.stream_history_beside_trends(streams.read_competitor_prices(spark, tempfile.mkdtemp(dir="/tmp", prefix="run-")))
    assert {"opened", "closed"}.isdisjoint(stream.columns) and "api_after" in stream.schema["newest"].dataType.names
    given = spark.createDataFrame([], stream.schema)
    written = jobs.trends_table("/nowhere")._newest(updating.trends_of(given))
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_summary_and_pair_signals_fold(spark, folder):
    """Latest prices in running aggregates; a dearer update and a deleted product are taken back."""
    path = write_lines(folder, "in", [[quote("a", "X", 900, 0), quote("a", "Y", 950, 0, False)], [quote("a", "X", 990, 9), quote("a", "Y", 100, -9)], SENTINEL])
    row = lambda s, op, cents: {"op": op, "op_ts": f"2024-01-01T00:00:{s:02d}Z", "before": {"sku": "a"}, "after": cents and {"sku": "a", "current_price": cents, "in_stock": True, "is_active": True}}
    changed = write_lines(folder, "changes", [[row(1, "c", 9.6)], [row(2, "u", 9.8)], [row(9, "d", None)]])
    goods = spark.createDataFrame([("a", 10.0)], "sku string, current_price double").withColumn("current_price", F.col("current_price").cast("decimal(10,2)"))
    rivals = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, code string")
    read = lambda: streams.read_competitor_prices(spark, path, files_per_batch=1)
    changes = lambda: streams.read_changelog(spark, changed, "sku string, current_price decimal(10,2), price_sensitivity string, in_stock boolean, is_active boolean", streaming=True, files_per_batch=1)
    assert not in_python(updating.stream_latest_prices(read())) and not in_python(updating.stream_prices_and_changes(read(), changes()))
    table = jobs.summary_table(f"{folder}/summary")
    jobs.summary_job(read(), lambda: goods, lambda: rivals, table, f"{folder}/cp1", "2024-01-04 00:00:00", trigger=None).awaitTermination()
    assert rows(table.read(spark), "cheapest_competitor_id", "cheapest_price", "competitor_count", "in_stock_competitor_count") == [(2, Decimal("9.50"), 2, 1)]
    pairs = jobs.pair_signals_table(f"{folder}/pairs")
    jobs.pair_signals_job(read(), changes(), lambda: rivals, pairs, f"{folder}/cp2", trigger=None).awaitTermination()
    log = spark.read.parquet(f"{folder}/pairs/log/writer=pairs")
    assert log.filter("batch = 0 and not deleted").count() == 3 and pairs.read(spark).count() == 0


def test_json_lines_are_packed(spark):
    """what a query writes as JSON text and reads back is compressed, in files of a bounded number of rows."""
    import glob

    from checks import registry
    from shelfwise.sources.retail import RetailTables

    path = registry._messages(RetailTables(spark, "/root/testdata/sf0.001"), spark.range(450_000).coalesce(1))
    assert len(glob.glob(f"{path.removeprefix('file:')}/*.txt.lz4")) == 3
    assert streams.file_records(spark, path, False).filter("value like '%id%'").count() == 450_000
