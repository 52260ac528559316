"""Every batch query by name: (spark, folder) -> DataFrame over the whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import configure, schemas
from shelfwise.config import DEFAULTS
from shelfwise.functions.columns import ago
from shelfwise.operators import behavior, demand, dims, elasticity, forecast, ingest, market, prices, proposals, signals
from shelfwise.plans import adjustments, competitors, demand_signals, overview, price_signals, price_trends
from shelfwise.plans import elasticity as elasticity_reports
from shelfwise.session import checkpoint_dir, configure_streaming
from shelfwise.sinks.tables import KeyedTable, append, append_by_day, dimension, export_csv, insert_ignore, insert_table, publish_dim, read_dim
from shelfwise.sources.retail import AS_OF, RetailStreams, RetailTables, sku_of
from shelfwise.sources import streams
from shelfwise.sources.tables import read_lookback, read_table
from shelfwise.streaming import jobs
from shelfwise.streaming.ordered import stream_low_24h, stream_previous_price

Query = Callable[[RetailTables], DataFrame]
RUN_ID = 7
DISPLAYS = ["Undercut", "Overpriced", "Abrupt Increase"]
CATEGORIES = ["ECONOMY", "LARGE", "PROMO"]
CODES = ["supplier#000000000", "supplier#000000002"]


def plain(df: DataFrame) -> DataFrame:
    """Engine-neutral column types: doubles to six places, wide integers, zone-free timestamps."""

    def convert(field: T.StructField):
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.DecimalType)):
            col = F.floor(col.cast("double") * 1e6 + 0.5) / F.lit(1e6)
        elif isinstance(kind, T.IntegralType):
            col = col.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            col = col.cast("timestamp_ntz")
        return col.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


def _wide(df: DataFrame) -> DataFrame:
    """The one nullable counter as a double, so every engine hands it over in the same type."""
    return df.withColumn("searches", F.col("searches").cast("double"))


# ---- shared frames -------------------------------------------------------------------


def _dims(t: RetailTables):
    return t.products, t.competitors


def _enriched(t: RetailTables, days: int = 2) -> DataFrame:
    return overview.enriched_signals(t.signals, *_dims(t), AS_OF, days)


def _trends(t: RetailTables) -> DataFrame:
    return price_trends.recent_trends(t.trends, AS_OF, days=2)


def _movements(t: RetailTables) -> DataFrame:
    return price_trends.recent_movements(t.movements, t.competitors, AS_OF, days=2)


def _gaps(t: RetailTables) -> DataFrame:
    return competitors.price_gaps(t.history, *_dims(t), AS_OF, days=2)


def _dvs(t: RetailTables) -> DataFrame:
    return demand_signals.dvs_enriched(t.dvs, t.products, AS_OF, days=2)


def _sensitivity(t: RetailTables) -> DataFrame:
    return elasticity_reports.sensitivity_history(t.sensitivity, t.products, AS_OF, days=30)


def _quotes(t: RetailTables) -> DataFrame:
    """Order lines as quotes that carry a competitor's own product id."""
    shop = F.element_at(F.array(*[F.lit(s) for s in ("amazon", "ebay", "bestbuy")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return t.raw("lineitem").select(
        shop.alias("competitor_name"),
        F.concat(F.upper(F.substring(shop, 1, 1)), F.col("l_partkey").cast("string")).alias("source_sku"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
    )


def _mapping(t: RetailTables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return t.raw("part").select(
        sku_of(F.col("p_partkey")).alias("universal_sku"),
        F.concat(F.lit("A"), key).alias("amazon_asin"),
        F.when(F.col("p_size") != 7, F.concat(F.lit("E"), key)).alias("ebay_item_id"),
        F.concat(F.lit("B"), key).alias("bestbuy_sku"),
    )


SHOPS = {"amazon_asin": "amazon", "ebay_item_id": "ebay", "bestbuy_sku": "bestbuy"}


def _archive(t: RetailTables) -> DataFrame:
    """Messages that repeat per shopper: the newest one per message id stays."""
    return ingest.archive_raw(
        t.behavior_envelopes.select(
            F.concat(F.lit("user-behavior-events_"), F.get_json_object("value", "$.product.sku")).alias("message_id"),
            "ingest_time",
            "value",
        )
    )


def _lineage(t: RetailTables) -> DataFrame:
    records = t.behavior_envelopes.select(
        F.get_json_object("value", "$.product.sku").alias("sku"), F.unix_millis("ingest_time").alias("ingest_ms")
    )
    return ingest.with_lineage(records, "user-behavior-events", "user-behavior", ["sku", "ingest_ms"], produced_at=AS_OF)


def _changed(t: RetailTables) -> DataFrame:
    return dims.apply_changelog(t.product_changes, ["sku"])


def _rollup(t: RetailTables) -> DataFrame:
    return elasticity.demand_rollup(t.behavior_summary, AS_OF)


def _candidates_ela(t: RetailTables) -> DataFrame:
    return elasticity.price_as_of(_rollup(t), t.products, t.price_history)


def _estimates(t: RetailTables) -> DataFrame:
    return elasticity.price_elasticity(t.observations, AS_OF)


def _windows(t: RetailTables) -> DataFrame:
    return forecast.history_windows(t.history, AS_OF)


def _wide_windows(t: RetailTables) -> DataFrame:
    return forecast.history_windows(t.history, AS_OF, minutes=720)


def _forecasts(t: RetailTables) -> DataFrame:
    return forecast.forecast_competitor_prices(t.history, AS_OF)


def _metric_forecasts(t: RetailTables) -> DataFrame:
    """Stored metrics in the shape of forecasts, for the operators that consume forecasts."""
    return t.metrics.withColumn("prediction", F.lit(880.0) + F.col("n_samples") + F.col("competitor_id") / F.lit(4.0)).withColumns(
        {"pred_diff": F.col("prediction") - F.col("last_price"), "pred_diff_pct": F.lit(float("nan"))}
    )


def _features(t: RetailTables) -> DataFrame:
    return proposals.pricing_features(t.products).join(
        proposals.demand_baseline(t.behavior_summary, AS_OF), "sku", "left"
    )


def _cheapest(t: RetailTables) -> DataFrame:
    return forecast.cheapest_reliable_forecast(_metric_forecasts(t))


def _apply_set(t: RetailTables, auto: bool = False) -> DataFrame:
    return proposals.apply_candidates(t.proposals, AS_OF, auto_pending=auto)


def _outcomes(t: RetailTables) -> DataFrame:
    return proposals.apply_proposals(t.products, _apply_set(t))


def _applied(t: RetailTables) -> proposals.Applied:
    return proposals.apply_outputs(t.products, t.proposals, _outcomes(t), AS_OF)


def _decisions(t: RetailTables) -> DataFrame:
    """A moderator's verdict per order; none yet on orders that are not open."""
    verdict = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "approved").otherwise("rejected")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", verdict).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lower("o_orderpriority")).alias("note"),
    )


def _proposed(t: RetailTables) -> DataFrame:
    return proposals.price_proposals(t.products, t.behavior_summary, _metric_forecasts(t), AS_OF, RUN_ID)


def _found(t: RetailTables) -> DataFrame:
    return adjustments.search_proposals(t.proposals, ["pending", "approved"], "2023-12-28 00:00:00", "sku-")


def _series(t: RetailTables):
    ours = adjustments.platform_price_series(t.price_history, t.products, AS_OF, days=2)
    theirs = adjustments.competitor_price_series(t.history, t.competitors, AS_OF, days=2)
    points = adjustments.proposal_points(t.proposals, AS_OF, days=7)
    return ours, theirs, points


def _place(t: RetailTables) -> str:
    """A new folder in shared storage for what one query writes and reads back."""
    return f"{checkpoint_dir(t.spark, t.spark.conf.get('spark.sql.warehouse.dir'))}/shelfwise-{uuid.uuid4().hex}"


def _upserted(t: RetailTables) -> DataFrame:
    """All prices through one keyed table: two writers with equal batch ids, and a compaction between them."""
    keys = ["product_sku", "competitor_name"]
    table = KeyedTable(_place(t), keys, ["event_time", "api_collection_ts_ms", "source_sku", "price"])
    columns = [*keys, "price", "in_stock", "event_time", "api_collection_ts_ms", "source_sku"]
    half = lambda k: t.prices.select(columns).filter(F.pmod(F.hash(*columns), F.lit(2)) == k)
    table.upsert(half(0), 0, writer="first")
    table.compact(t.spark, upto=0)
    table.upsert(half(1), 0, writer="second")
    return table.read(t.spark).select(*keys, "price", "in_stock", "event_time")


def _inserted(t: RetailTables) -> DataFrame:
    """Keys of all price records, inserted twice over."""
    keys = ["product_sku", "competitor_name", "data_ts_ms"]
    path = _place(t)
    rows = t.prices.select(*keys, "price").filter("data_ts_ms is not null")
    insert_ignore(rows.filter(F.col("price") >= 1000), path, keys)
    insert_ignore(rows, path, keys)
    return read_table(t.spark, path).select(keys)


def _inserted_once(t: RetailTables) -> DataFrame:
    """All price records into a table that keeps the first per key: two writers, one batch replayed, a compaction between."""
    keys = ["product_sku", "competitor_name", "data_ts_ms"]
    table = insert_table(_place(t), keys, ["kafka_ts", "source_sku", "price"])
    rows = t.prices.select(*keys, "price", "source_sku", "kafka_ts").filter("data_ts_ms is not null")
    cheap = F.col("price") < 950
    table.upsert(rows.filter(cheap), 0, writer="cheap")
    table.compact(t.spark, upto=0)
    table.upsert(rows.filter(~cheap), 0, writer="dear")
    table.upsert(rows.filter(cheap), 0, writer="cheap")
    return table.read(t.spark)


def _slid_elasticity(t: RetailTables) -> DataFrame:
    """The slopes as of now from a window of six hours ago: hours that came in added, hours that left taken away."""
    ago_h = lambda h: ago(AS_OF, hours=h)
    path = _place(t)
    old = F.col("observed_at") < ago_h(6)
    append_by_day(elasticity.hourly_moments(t.observations.filter(old)), path, "hour", 0)
    append_by_day(elasticity.hourly_moments(t.observations.filter(~old)), path, "hour", 1)
    hourly = read_lookback(t.spark, path, "hour", AS_OF, hours=79)
    between = lambda *bounds: elasticity.moments_between(hourly, t.observations, *bounds)
    window = between(ago_h(78), ago_h(6))
    moved = elasticity.slide_moments(window, between(ago_h(6)), between(ago_h(78), ago_h(72)))
    return elasticity.elasticity_of(moved)


def _gaps_by_day(t: RetailTables) -> DataFrame:
    """The two-day gap report on a history laid out by day."""
    path = _place(t)
    append_by_day(t.history, path, "data_timestamp", 0)
    recent = read_lookback(t.spark, path, "data_timestamp", AS_OF, days=2)
    return competitors.price_gaps(recent, *_dims(t), AS_OF, days=2)


def _exported(t: RetailTables) -> DataFrame:
    """The price history as CSV files, read back."""
    path = _place(t)
    export_csv(t.history, path)
    return t.spark.read.option("header", True).schema(t.history.schema).csv(path)


def _published(t: RetailTables) -> DataFrame:
    """Change events published to a keyed dimension in two batches, the newer half first, and read back."""
    table = dimension(_place(t), ["sku"])
    changes = t.product_changes
    middle = F.lit("2024-01-02 00:00:00").cast("timestamp")
    publish_dim(dims.latest_changes(changes.filter(F.col("op_ts") >= middle), ["sku"]), table, 0)
    publish_dim(dims.latest_changes(changes.filter(F.col("op_ts") < middle), ["sku"]), table, 1)
    return read_dim(t.spark, table).select("sku", "current_price", "in_stock", "op_ts")


# JSON lines repeat their field names, so a fast codec leaves a fraction of them on disk; packed files are not
# split, so a file holds what one task reads quickly
PACKED = {"compression": "lz4", "maxRecordsPerFile": 200_000}


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def _messages(t: RetailTables, df: DataFrame) -> str:
    """Folder of JSON lines, one per row of ``df``, and of lines that are broken or no document."""
    path = _place(t)
    _lines(df).write.options(**PACKED).text(path)
    t.spark.createDataFrame([("{broken",), ("no document",), ("{}",), ("",)], "value string").write.mode("append").text(path)
    return path


def _dealt(t: RetailTables, parts: list[DataFrame], path: str) -> int:
    """Write parts as JSON lines, one after the other and each in as many files as it has tasks; the number of files of the first.

    Files are read oldest first, so a stream that takes that many a batch has the first part in a batch of its own.
    """
    for k, part in enumerate(parts):
        _lines(part).write.mode("append").options(**PACKED).text(path)
        if k == 0:
            first = len(t.spark.read.text(path).inputFiles())
    return first


def _read_prices(t: RetailTables, streaming: bool) -> DataFrame:
    """Prices as the stream reader decodes them, as one batch or by a query that takes what is there."""
    columns = ["product_sku", "competitor_name", "price", "in_stock", "source_sku", "api_collection_ts_ms"]
    read = streams.read_competitor_prices(t.spark, _messages(t, t.prices.select(*columns, "data_ts_ms")), streaming=streaming)
    decoded = read.select(*columns, "event_time")
    if not streaming:
        return decoded
    place = _place(t)
    write = lambda df, batch_id: append(df, f"{place}/rows", batch_id)
    jobs.start(decoded, write, f"{place}/checkpoint", trigger=None).awaitTermination()
    return t.spark.read.schema(decoded.schema).parquet(f"{place}/rows/batch=*")


def _read_behavior(t: RetailTables) -> DataFrame:
    read = streams.read_user_behavior(t.spark, _messages(t, t.behavior.drop("event_time")), streaming=False)
    return _wide(behavior.behavior_events(read))


def _read_changes(t: RetailTables) -> DataFrame:
    read = streams.read_changelog(t.spark, _messages(t, t.product_changes), schemas.PRODUCT)
    return dims.apply_changelog(read, ["sku"]).select("sku", "current_price", "in_stock", "op_ts")


def _drained(t: RetailTables, build) -> DataFrame:
    """Run a streaming job over all of the streamed table and return the rows it emitted, kept in shared storage."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider, None)
    configure_streaming(t.spark)
    try:
        stream = build(RetailStreams(t.spark, t.folder))
        place = _place(t)
        write = lambda df, batch_id: append(df, f"{place}/rows", batch_id)
        jobs.start(stream, write, f"{place}/checkpoint", trigger=None).awaitTermination()
    finally:
        t.spark.conf.set(provider, before) if before else t.spark.conf.unset(provider)
    return t.spark.read.schema(stream.schema).parquet(f"{place}/rows/batch=*")


def _streamed(t: RetailTables, run) -> None:
    """``run`` starts a streaming job that takes what is there; its state is kept in the store that stateful operators need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider, None)
    configure_streaming(t.spark)
    try:
        run(RetailStreams(t.spark, t.folder)).awaitTermination()
    finally:
        t.spark.conf.set(provider, before) if before else t.spark.conf.unset(provider)


def _rivals(t: RetailTables):
    return lambda: t.competitors


def _goods(t: RetailTables):
    return lambda: t.products


def _stream_current_signals(t: RetailTables) -> DataFrame:
    place = _place(t)
    table = KeyedTable(f"{place}/signals", signals.SIGNAL_KEY, jobs.SIGNAL_ORDER)
    _streamed(t, lambda s: jobs.signals_job(s.marked_prices, _goods(t), _rivals(t), table, f"{place}/moves", f"{place}/checkpoint", AS_OF, trigger=None))
    return table.read(t.spark)


def _stream_market_summary(t: RetailTables) -> DataFrame:
    """In micro-batches of JSON files, so that prices rise and fall between them."""
    place, table = _place(t), jobs.summary_table(_place(t))
    columns = ["product_sku", "competitor_name", "price", "in_stock", "source_sku", "api_collection_ts_ms", "data_ts_ms"]
    halves = [t.prices.select(columns).filter(F.pmod(F.col("api_collection_ts_ms"), F.lit(2000)) == k) for k in (0, 1000)]
    files = _dealt(t, halves, f"{place}/in")
    read = streams.read_competitor_prices(t.spark, f"{place}/in", files_per_batch=files)
    _streamed(t, lambda s: jobs.summary_job(read, _goods(t), _rivals(t), table, f"{place}/checkpoint", AS_OF, trigger=None))
    return table.read(t.spark).drop("version")


def _stream_pair_signals(t: RetailTables) -> DataFrame:
    """Prices in the first batch; product changes in two, the later ones after the prices."""
    place, table = _place(t), jobs.pair_signals_table(_place(t))
    changes, middle = t.product_changes, F.lit("2024-01-02 12:00:00").cast("timestamp")
    files = _dealt(t, [changes.filter(F.col("op_ts") < middle), changes.filter(F.col("op_ts") >= middle)], f"{place}/changes")
    read = streams.read_changelog(t.spark, f"{place}/changes", schemas.PRODUCT, streaming=True, files_per_batch=files)
    _streamed(t, lambda s: jobs.pair_signals_job(s.prices, read, _rivals(t), table, f"{place}/checkpoint", trigger=None))
    return table.read(t.spark).drop("version")


DIM_ROWS = {
    "products": schemas.PRODUCT,
    "competitors": "id bigint, name string",
    "behavior": "product_sku string, window_end timestamp, page_views bigint",
    "signals": "signal_type string, competitor_price decimal(10,2), is_active boolean",
}


def _dim_changes(t: RetailTables) -> DataFrame:
    """Changes of four tables in one stream: every row created, some changed or deleted later, some deletes older than the row."""

    def feed(df: DataFrame, source: str, key, op: str, at, *after) -> DataFrame:
        return df.select(F.lit(source).alias("source"), key.cast("string").alias("row_key"), F.lit(op).alias("op"), at.alias("op_ts"), F.to_json(F.struct(*after)).alias("after"))

    later = F.expr("interval 1 minute")
    goods = t.product_changes
    products = goods.select(
        F.lit("products").alias("source"), F.coalesce("after.sku", "before.sku").alias("row_key"), "op", "op_ts", F.to_json("after").alias("after")
    )
    chain = t.raw("supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 5).alias("id"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("s_suppkey").cast("int"))
    kept = feed(chain.filter("s_suppkey % 7 <> 0"), "competitors", F.col("id"), "u", at, "id", F.col("s_name").alias("name"))
    closed = feed(chain.filter("s_suppkey % 7 = 0"), "competitors", F.col("id"), "d", at, "id")
    shop = t.behavior_summary
    key = F.concat_ws("|", "product_sku", F.unix_seconds("window_start"))
    made = feed(shop, "behavior", key, "c", F.col("window_end"), "product_sku", "window_end", "page_views")
    stale = feed(shop.filter("purchases % 2 = 0"), "behavior", key, "d", F.col("window_end") - later, "product_sku")
    dropped = feed(shop.filter("purchases % 3 = 0"), "behavior", key, "d", F.col("window_end") + later, "product_sku")
    key = F.concat_ws("|", "product_sku", "competitor_id", "signal_type")
    raised = feed(t.signals, "signals", key, "c", F.col("signal_timestamp"), "signal_type", "competitor_price", "is_active")
    ended = feed(t.signals.filter("priority = 1"), "signals", key, "u", F.col("signal_timestamp") + later, "signal_type", "competitor_price", F.lit(False).alias("is_active"))
    first = [products.filter("op_ts >= '2024-01-02'"), kept, made, raised]
    second = [products.filter("op_ts < '2024-01-02'"), closed, stale, dropped, ended]
    return [reduce(DataFrame.unionByName, part) for part in (first, second)]


def _stream_dims(t: RetailTables) -> DataFrame:
    place = _place(t)
    files = _dealt(t, _dim_changes(t), f"{place}/changes")
    tables = {name: (jobs.change_table(f"{place}/{name}"), ddl) for name, ddl in DIM_ROWS.items()}
    read = streams.read_table_changes(t.spark, f"{place}/changes", files_per_batch=files)
    _streamed(t, lambda s: jobs.dims_job(read, tables, f"{place}/checkpoint", trigger=None))
    shown = {
        "products": (F.col("current_price"), F.col("price_sensitivity")),
        "competitors": (F.col("id"), F.col("name")),
        "behavior": (F.col("page_views"), F.col("product_sku")),
        "signals": (F.col("competitor_price"), F.concat_ws("|", "signal_type", "is_active")),
    }
    rows = [
        table.read(t.spark).select(F.lit(name).alias("source"), "row_key", shown[name][0].cast("double").alias("amount"), shown[name][1].alias("label"), "op_ts")
        for name, (table, _) in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _beside(t: RetailTables) -> tuple[str, KeyedTable]:
    place = _place(t)
    table = jobs.trends_table(f"{place}/trends")
    _streamed(t, lambda s: jobs.history_and_trends_job(s.marked_prices, _rivals(t), f"{place}/history", table, f"{place}/checkpoint", trigger=None))
    return f"{place}/history/batch=*", table


def _signal_stream(t: RetailTables) -> DataFrame:
    """The stored signals as a stream with a watermark on their time."""
    path = _place(t)
    t.signals.write.parquet(path)
    live = t.spark.readStream.schema(t.signals.schema).parquet(path)
    return streams.with_watermark(live.withColumn("event_time", F.col("signal_timestamp")), "event_time", DEFAULTS.signal_watermark)


def _read_latest(t: RetailTables) -> DataFrame:
    """A query that starts at the latest record: files from before its start, from after it, and from after a restart."""
    place = _place(t)
    columns = ["product_sku", "competitor_name", "price", "in_stock", "source_sku", "api_collection_ts_ms", "data_ts_ms"]
    parts = [t.prices.select(columns).filter(F.pmod(F.col("api_collection_ts_ms") / 1000, F.lit(3)) == k) for k in range(3)]
    add = lambda k: parts[k].select(F.to_json(F.struct(*columns)).alias("value")).write.mode("append").text(f"{place}/in")
    write = lambda df, batch_id: append(df, f"{place}/rows", batch_id)
    add(0)
    streams.fixed_start(t.spark, f"{place}/checkpoint")
    for k in (1, 2):
        add(k)
        read = streams.read_competitor_prices(t.spark, f"{place}/in", starting="latest", checkpoint=f"{place}/checkpoint")
        decoded = read.select(*[c for c in columns if c != "data_ts_ms"], "event_time")
        jobs.start(decoded, write, f"{place}/checkpoint", trigger=None).awaitTermination()
    return t.spark.read.schema(decoded.schema).parquet(f"{place}/rows/batch=*")


def _stream_movements(t: RetailTables) -> DataFrame:
    lagged = _drained(t, lambda s: stream_previous_price(s.marked_prices))
    return jobs.price_movements_of(lagged, lambda: t.products, lambda: t.competitors)


def _stream_increases(t: RetailTables) -> DataFrame:
    lows = _drained(t, lambda s: stream_low_24h(s.marked_prices))
    return jobs.price_increases_of(lows, lambda: t.products, lambda: t.competitors, AS_OF)


# the hours the streamed prices cover
HOURS = [f"2024-01-{d:02d} {h:02d}:00" for d in range(1, 5) for h in range(24)]

QUERIES: dict[str, Query] = {
    # ingest
    "flatten_competitor_prices": lambda t: ingest.flatten_competitor_prices(t.market_envelopes),
    "flatten_aggregator_prices": lambda t: ingest.flatten_aggregator_prices(t.market_envelopes),
    "flatten_user_behavior": lambda t: _wide(ingest.flatten_user_behavior(t.behavior_envelopes)),
    "map_source_skus": lambda t: ingest.map_source_skus(_quotes(t), _mapping(t), SHOPS),
    "with_lineage": _lineage,
    "archive_raw": lambda t: _archive(t).select(
        "message_id", "ingest_time", F.get_json_object("value", "$.user_behavior.page_views").cast("bigint").alias("page_views")
    ),
    # dimensions
    "apply_changelog": lambda t: _changed(t).select("sku", "current_price", "in_stock", "op_ts"),
    "products_dim": lambda t: dims.products_dim(_changed(t)),
    "competitors_dim": lambda t: dims.competitors_dim(t.competitors),
    "behavior_dim": lambda t: dims.behavior_dim(t.behavior_summary).drop("op_ts"),
    "signals_dim": lambda t: dims.signals_dim(t.signals).drop("op_ts"),
    # prices
    "competitor_prices": lambda t: t.prices.drop("data_ts_ms"),
    "dedup_prices": lambda t: prices.dedup_prices(t.prices),
    "competitor_price_history": lambda t: t.history,
    "price_window_stats": lambda t: prices.price_window_stats(t.prices),
    "price_trends": lambda t: t.trends,
    # signals
    "undercut_signals": lambda t: signals.undercut_signals(t.prices, *_dims(t)),
    "undercut_signals_strict": lambda t: signals.undercut_signals(t.prices, *_dims(t), strict=True),
    "overpriced_signals": lambda t: signals.overpriced_signals(t.prices, *_dims(t)),
    "stockout_signals": lambda t: signals.stockout_signals(t.prices, *_dims(t)),
    "price_increase_signals": lambda t: signals.price_increase_signals(t.prices, *_dims(t), as_of=AS_OF),
    "price_movements": lambda t: t.movements,
    "current_signals": lambda t: t.signals,
    # market
    "latest_prices": lambda t: market.latest_prices(t.prices),
    "competitor_counts": lambda t: market.competitor_counts(market.latest_prices(t.prices)),
    "cheapest_competitor": lambda t: market.cheapest_competitor(market.latest_prices(t.prices)),
    "product_market_summary": lambda t: t.summary,
    # behaviour and demand
    "behavior_events": lambda t: _wide(behavior.behavior_events(t.behavior)),
    "behavior_summary": lambda t: t.behavior_summary,
    "signal_windows": lambda t: demand.signal_windows(t.signals),
    "behavior_with_previous": lambda t: demand.behavior_with_previous(t.behavior_summary),
    "demand_vs_signals": lambda t: t.dvs,
    # elasticity
    "demand_rollup": _rollup,
    "price_as_of": _candidates_ela,
    "new_observations": lambda t: elasticity.new_observations(_candidates_ela(t), t.observations),
    "price_elasticity": _estimates,
    "incremental_elasticity": _slid_elasticity,
    "sensitivity_labels": lambda t: elasticity.label_estimates(_estimates(t)),
    "apply_sensitivity": lambda t: elasticity.apply_sensitivity(t.products, _estimates(t), AS_OF),
    "sensitivity_history_rows": lambda t: elasticity.sensitivity_history_rows(t.products, _estimates(t), AS_OF),
    # forecast
    "history_windows": _windows,
    "recent_competitors": lambda t: forecast.recent_competitors(t.history, AS_OF),
    "forecast_features": lambda t: t.features,
    "naive_forecast": lambda t: forecast.naive_forecast(_wide_windows(t)),
    "cv_folds": lambda t: forecast.cv_folds(t.features),
    "forecast_baseline_mae": lambda t: forecast.baseline_mae(t.features),
    "score_reliability": lambda t: forecast.score_reliability(t.metrics).select(
        "sku", "competitor_id", "cv_mae", "baseline_mae", "confidence", "reliable"
    ),
    "forecast_competitor_prices": _forecasts,
    "cheapest_reliable_forecast": _cheapest,
    "forecast_metrics": lambda t: forecast.forecast_metrics(_metric_forecasts(t), RUN_ID, AS_OF),
    # proposals
    "pricing_features": lambda t: proposals.pricing_features(t.products),
    "demand_baseline": lambda t: proposals.demand_baseline(t.behavior_summary, AS_OF),
    "forecast_proposals": lambda t: proposals.forecast_proposals(_features(t), _cheapest(t)),
    "grid_proposals": lambda t: proposals.grid_proposals(_features(t)),
    "price_proposals": _proposed,
    "should_run": lambda t: proposals.should_run(t.runs, t.history, AS_OF),
    "run_record": lambda t: proposals.run_record(
        proposals.pricing_features(t.products), _proposed(t), RUN_ID, AS_OF, "2024-01-04 00:05:00"
    ),
    "apply_candidates": lambda t: _apply_set(t),
    "apply_candidates_auto": lambda t: _apply_set(t, auto=True),
    "apply_proposals": _outcomes,
    "applied_products": lambda t: _applied(t).products.select("sku", "current_price", "updated_at"),
    "applied_history": lambda t: _applied(t).history.drop("source", "reason_code"),
    "applied_proposals": lambda t: _applied(t).proposals.select("id", "status", "notes", "applied_at"),
    "applied_counts": lambda t: _applied(t).counts,
    "moderate": lambda t: proposals.moderate(t.proposals, _decisions(t), AS_OF).select(
        "id", "status", "approved_at", "approved_by", "notes"
    ),
    # overview
    "competitor_stats": lambda t: overview.competitor_stats(t.signals, t.competitors, AS_OF),
    "product_stats": lambda t: overview.product_stats(t.signals, t.products, AS_OF),
    "enriched_signals": lambda t: overview.enriched_signals(t.signals, *_dims(t), AS_OF, days=2, ordered=True),
    "signal_freshness": lambda t: overview.signal_freshness(t.signals, AS_OF),
    "pipeline_status": lambda t: overview.pipeline_status(t.signals, t.trends, t.summary, AS_OF),
    "engagement_delta": lambda t: overview.engagement_delta(t.behavior_summary, AS_OF),
    "top_opportunities": lambda t: overview.top_opportunities(t.dvs, t.products, AS_OF),
    "signal_kpis": lambda t: overview.signal_kpis(_enriched(t)),
    "market_kpis": lambda t: overview.market_kpis(t.summary),
    "priority_queue_high": lambda t: overview.priority_queue(_enriched(t), 1),
    "priority_queue_medium": lambda t: overview.priority_queue(_enriched(t), 2),
    "signal_type_counts": lambda t: overview.signal_type_counts(_enriched(t)),
    "signal_category_counts": lambda t: overview.signal_category_counts(_enriched(t)),
    "market_exposure": lambda t: overview.market_exposure(t.summary, t.competitors, t.products),
    "market_leaderboard": lambda t: overview.market_leaderboard(t.summary, t.competitors, t.products),
    "market_leaderboard_undercut": lambda t: overview.market_leaderboard(
        t.summary, t.competitors, t.products, undercut_only=True
    ),
    "top_undercutters": lambda t: overview.top_undercutters(_enriched(t)),
    "filter_categories": lambda t: overview.filter_categories(t.summary, t.products, CATEGORIES),
    "all_categories": lambda t: overview.all_categories(_enriched(t), t.products),
    "trend_snapshot": lambda t: overview.trend_snapshot(t.trends, AS_OF)
    .groupBy("trend_direction")
    .agg(F.count(F.lit(1)).alias("windows")),
    # trends page
    "recent_trends": lambda t: price_trends.recent_trends(t.trends, AS_OF, days=1, codes=["Supplier#000000001"], ordered=True),
    "trend_shares": lambda t: price_trends.trend_shares(_trends(t)),
    "price_movers": lambda t: price_trends.price_movers(_trends(t)),
    "top_gainers": lambda t: price_trends.top_movers(_trends(t)),
    "top_decliners": lambda t: price_trends.top_movers(_trends(t), rising=False),
    "volatility_ranking": lambda t: price_trends.volatility_ranking(_trends(t)),
    "hourly_prices": lambda t: price_trends.hourly_prices(_trends(t)),
    "hourly_price_pivot": lambda t: price_trends.hourly_price_pivot(_trends(t), HOURS),
    "volatility_by_pair": lambda t: price_trends.volatility_by_pair(_trends(t)),
    "recent_movements": lambda t: price_trends.recent_movements(t.movements, t.competitors, AS_OF, days=2, ordered=True),
    "movement_counts": lambda t: price_trends.movement_counts(_movements(t)),
    "movement_direction_counts": lambda t: price_trends.movement_direction_counts(_movements(t)),
    "movement_histogram": lambda t: price_trends.movement_histogram(_movements(t)),
    "latest_movements": lambda t: price_trends.latest_movements(_movements(t)),
    "movements_of_selection": lambda t: price_trends.movements_or_all(_movements(t), codes=CODES),
    "movements_or_all": lambda t: price_trends.movements_or_all(_movements(t), codes=["nobody"]),
    # signals page
    "triage": lambda t: price_signals.triage(
        _enriched(t), categories=CATEGORIES, displays=DISPLAYS, priorities=[1, 2], min_gap=3.0
    ),
    "signal_page_kpis": lambda t: price_signals.signal_page_kpis(_enriched(t)),
    "signals_by_competitor": lambda t: price_signals.signals_by_competitor(_enriched(t)),
    "signals_per_hour": lambda t: price_signals.signals_per_hour(_enriched(t)),
    "latest_signal_per_competitor": lambda t: price_signals.latest_signal_per_competitor(_enriched(t)),
    "competitor_aggression": lambda t: price_signals.competitor_aggression(_enriched(t)),
    "top_affected_products": lambda t: price_signals.top_affected_products(_enriched(t)),
    "competitor_signal_mix": lambda t: price_signals.competitor_signal_mix(_enriched(t)),
    "product_signal_history": lambda t: price_signals.product_signal_history(_enriched(t)),
    # competitor page
    "price_gaps_by_day": _gaps_by_day,
    "price_gaps": lambda t: competitors.price_gaps(t.history, *_dims(t), AS_OF, days=2, ordered=True),
    "competitor_kpis": lambda t: competitors.competitor_kpis(_gaps(t)),
    "category_competitor_prices": lambda t: competitors.category_competitor_prices(_gaps(t)),
    "our_category_prices": lambda t: competitors.our_category_prices(_gaps(t)),
    "category_price_comparison": lambda t: competitors.category_price_comparison(_gaps(t)),
    "gap_distribution": lambda t: competitors.gap_distribution(_gaps(t)),
    "gap_histogram": lambda t: competitors.gap_histogram(_gaps(t)),
    "top_undercut_products": lambda t: competitors.top_undercut_products(_gaps(t)),
    "price_history_comparison": lambda t: competitors.price_history_comparison(_gaps(t), codes=CODES),
    # demand page
    "dvs_enriched": _dvs,
    "filter_by_competitor_signals": lambda t: demand_signals.filter_by_competitor_signals(
        t.dvs, t.signals, [1, 3], AS_OF, days=1
    ),
    "dvs_kpis": lambda t: demand_signals.dvs_kpis(_dvs(t)),
    "score_over_time": lambda t: demand_signals.score_over_time(_dvs(t)),
    "engagement_by_category": lambda t: demand_signals.engagement_by_category(_dvs(t)),
    "top_scored": lambda t: demand_signals.top_scored(_dvs(t)),
    "risk_triage": lambda t: demand_signals.risk_triage(_dvs(t)),
    "category_impact": lambda t: demand_signals.category_impact(_dvs(t)),
    "dvs_details": lambda t: demand_signals.dvs_details(_dvs(t)),
    # elasticity page
    "sensitivity_history": _sensitivity,
    "sensitivity_kpis": lambda t: elasticity_reports.sensitivity_kpis(t.products),
    "observation_count": lambda t: elasticity_reports.observation_count(t.observations, t.products, AS_OF),
    "elasticity_over_time": lambda t: elasticity_reports.elasticity_over_time(_sensitivity(t)),
    "elasticity_per_sku": lambda t: elasticity_reports.elasticity_over_time(_sensitivity(t), per_sku=True),
    "elasticity_histogram": lambda t: elasticity_reports.elasticity_histogram(_sensitivity(t)),
    "elasticity_by_category": lambda t: elasticity_reports.elasticity_by_category(_sensitivity(t)),
    "recent_sensitivity": lambda t: elasticity_reports.recent_sensitivity(_sensitivity(t)),
    # adjustments page
    "search_proposals": _found,
    "recent_runs": lambda t: adjustments.recent_runs(t.runs),
    "recent_price_changes": lambda t: adjustments.recent_price_changes(t.price_history, AS_OF),
    "proposal_kpis": lambda t: adjustments.proposal_kpis(t.proposals, t.runs, t.price_history, AS_OF),
    "forecast_kpis": lambda t: adjustments.forecast_kpis(adjustments.scored_metrics(t.metrics)),
    "forecast_by_sku": lambda t: adjustments.forecast_by_sku(adjustments.scored_metrics(t.metrics)),
    "forecast_by_competitor": lambda t: adjustments.forecast_by_competitor(adjustments.scored_metrics(t.metrics)),
    "mae_by_sku": lambda t: adjustments.mae_by_sku(t.metrics),
    "mae_by_sku_long": lambda t: adjustments.mae_by_sku_long(t.metrics),
    "platform_price_series": lambda t: _series(t)[0],
    "competitor_price_series": lambda t: _series(t)[1],
    "proposal_steps": lambda t: adjustments.proposal_steps(t.proposals, AS_OF),
    "upcoming_proposals": lambda t: adjustments.upcoming_proposals(t.proposals, AS_OF),
    "platform_price_steps": lambda t: adjustments.platform_price_steps(t.price_history, t.products, AS_OF, days=2),
    "series_overlap": lambda t: adjustments.series_overlap(
        adjustments.platform_price_bounds(t.products, AS_OF, days=2), *_series(t)[1:]
    ),
    "adjusted_skus": lambda t: adjustments.adjusted_skus(t.proposals, t.price_history, AS_OF),
    # sources: written as JSON lines, broken ones among them, and read back
    "source_prices": lambda t: _read_prices(t, streaming=False),
    "source_prices_stream": lambda t: _read_prices(t, streaming=True),
    "source_prices_latest": _read_latest,
    "source_behavior": _read_behavior,
    "source_changelog": _read_changes,
    # sinks: written, read back
    "upsert_latest": _upserted,
    "insert_ignore": _inserted,
    "insert_once": _inserted_once,
    "export_csv": _exported,
    "publish_dim": _published,
    # streaming
    "stream_price_trends": lambda t: _drained(t, lambda s: jobs.stream_price_trends(s.marked_prices)),
    "stream_behavior_summary": lambda t: _drained(t, lambda s: jobs.stream_behavior_summary(s.marked_behavior)),
    "stream_price_movements": _stream_movements,
    "stream_price_increases": _stream_increases,
    "stream_current_signals": _stream_current_signals,
    "stream_market_summary": _stream_market_summary,
    "stream_pair_signals": _stream_pair_signals,
    "stream_dims": _stream_dims,
    "stream_price_history": lambda t: t.spark.read.parquet(_beside(t)[0]),
    "stream_trends_table": lambda t: _beside(t)[1].read(t.spark),
    "stream_signal_windows": lambda t: _drained(t, lambda s: jobs.stream_signal_windows(_signal_stream(t))),
    "stream_demand_vs_signals": lambda t: _drained(t, lambda s: jobs.stream_demand_vs_signals(s.behavior, _signal_stream(t))),
}


def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(query(RetailTables(configure(spark), folder)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(query) for name, query in QUERIES.items()}
