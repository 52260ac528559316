"""Streaming jobs: the batch operators on streams, plus sinks, fan-out and start."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import instant, pct_of, tumbling
from shelfwise.operators import behavior, demand, prices, signals
from shelfwise.sinks.tables import KeyedTable, append
from shelfwise.streaming import updating
from shelfwise.streaming.ordered import stream_priced_pairs

BatchOp = Callable[[DataFrame], DataFrame]
BatchSink = Callable[[DataFrame, int], None]
DimReader = Callable[[], DataFrame]


def stream_price_trends(stream: DataFrame) -> DataFrame:
    """Five-minute trends, each emitted once when the watermark closes its window."""
    return prices.price_trends(stream)


def stream_behavior_summary(stream: DataFrame) -> DataFrame:
    return behavior.behavior_summary(stream)


def stream_signal_windows(stream: DataFrame) -> DataFrame:
    return demand.signal_windows(stream)


def stream_latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest row per key as a running aggregate, for update mode."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return stream.groupBy(*keys).agg(newest).select(*keys, "r.*")


def enrich_batch(batch: DataFrame, products: DimReader, competitors: DimReader) -> DataFrame:
    """Join a micro-batch to the dimensions as they are now; they are read again for every batch."""
    return signals.with_dimensions(batch, products(), competitors())


def price_movements_of(batch: DataFrame, products: DimReader, competitors: DimReader, settings: Settings = DEFAULTS):
    """Movements of a micro-batch of ``stream_previous_price`` rows."""
    joined = enrich_batch(batch, products, competitors).filter(signals.sellable())
    return signals.movement_rows(joined, settings.movement_pct)


def price_increases_of(
    batch: DataFrame, products: DimReader, competitors: DimReader, as_of, settings: Settings = DEFAULTS
) -> DataFrame:
    """24-hour increases of a micro-batch of ``stream_low_24h`` rows."""
    joined = enrich_batch(batch, products, competitors)
    return signals.emit(joined, signals.increase_case(settings.increase_24h_pct, as_of, settings.settle_minutes))


def row_signals_of(batch: DataFrame, products: DimReader, competitors: DimReader, settings: Settings = DEFAULTS):
    """Undercut, overpriced and stock-out signals of a micro-batch of plain prices."""
    joined = enrich_batch(batch, products, competitors)
    return signals.emit(
        joined,
        signals.undercut_case(False, settings.undercut_pct),
        signals.overpriced_case(settings.overpriced_pct),
        signals.stockout_case(),
    )


def behavior_with_previous_windows(stream: DataFrame, width: str = "5 minutes", delay: str = "5 minutes") -> DataFrame:
    """Search rate of each window beside that of the window before, in one stateful aggregation.

    Every event also counts, marked as past, one window later, so no self-join of the stream
    is needed. The watermark is late by one more window, because shifted times run ahead.
    """
    shift = F.expr(f"interval {width}")
    copies = stream.select(
        F.col("sku").alias("product_sku"), "searches", "page_views", "event_time", F.explode(F.array(F.lit(0), F.lit(1))).alias("past")
    )
    shifted = copies.select(
        "product_sku", "searches", "page_views", "past",
        F.when(F.col("past") == 1, F.col("event_time") + shift).otherwise(F.col("event_time")).alias("shifted"),
    )
    if stream.isStreaming:
        late = f"{_minutes(delay) + _minutes(width)} minutes"
        shifted = shifted.withWatermark("shifted", late)
    total = lambda c, past: F.sum(F.when(F.col("past") == past, F.coalesce(F.col(c), F.lit(0))))

    def rate(past: int) -> Column:
        views, found = total("page_views", past), total("searches", past)
        return F.when(views > 0, found / views).when(views.isNotNull(), F.lit(0.0))

    return (
        shifted.groupBy("product_sku", tumbling(F.col("shifted"), width).alias("w"))
        .agg(rate(0).alias("search_rate"), rate(1).alias("prev_search_rate"))
        .filter(F.col("search_rate").isNotNull())
    )


def _minutes(text: str) -> int:
    return int(text.split()[0])


def stream_demand_vs_signals(behavior_stream: DataFrame, signal_stream: DataFrame) -> DataFrame:
    """Scored windows: behaviour windows left-joined to signal windows of the same sku and time.

    ``behavior_stream`` comes without a watermark (the shifted time gets its own);
    ``signal_stream`` is watermarked on ``event_time``.
    """
    left = behavior_with_previous_windows(behavior_stream)
    kind = F.upper("signal_type")
    gap = F.abs(F.col("percentage_diff"))
    right = (
        signal_stream.groupBy("product_sku", tumbling(F.col("event_time")).alias("w"))
        .agg(
            *[F.count(F.when(kind == t, 1)).alias(f"{n}_cnt") for n, t in demand.GAPS.items()],
            *[F.avg(F.when(kind == t, gap)).cast("double").alias(f"avg_{n}_gap_pct") for n, t in demand.GAPS.items()],
        )
    )
    joined = left.join(right, ["product_sku", "w"], "left_outer")
    return demand.score_windows(
        joined.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
    )


def signals_of(batch: DataFrame, products: DimReader, competitors: DimReader, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Signals of all four rules of a micro-batch of ``stream_priced_pairs`` rows, the newest per pair and kind."""
    return signals.newest_of(enrich_batch(batch, products, competitors), signals.cases(as_of, settings))


SIGNAL_ORDER = ("signal_timestamp", "competitor_price", "in_stock")


def signals_job(
    stream: DataFrame, products: DimReader, competitors: DimReader, table: KeyedTable, movements: str, checkpoint: str, as_of,
    settings: Settings = DEFAULTS, trigger: str | None = "10 seconds",
) -> StreamingQuery:
    """Prices to signals and movements: one read, one state per pair, one table of current signals.

    ``table`` is keyed by ``signals.SIGNAL_KEY`` and ordered by ``SIGNAL_ORDER``; ``movements`` is an append path.
    """
    moves = lambda b: price_movements_of(b, products, competitors, settings)
    found = lambda b: signals_of(b, products, competitors, as_of, settings)
    outputs = [(found, upsert_sink(table, "signals")), (moves, lambda df, batch_id: append(df, movements, batch_id))]
    # a batch is kept while both outputs read it: only what they read
    priced = stream_priced_pairs(stream).drop("api_collection_ts_ms", "source_sku")
    return start(priced, fan_out(outputs, f"{checkpoint}/rows"), checkpoint, trigger)


def summary_of(batch: DataFrame, products: DimReader, competitors: DimReader, as_of) -> DataFrame:
    """Market summary rows of ``updating.cheapest_of`` rows with a ``version``."""
    theirs = competitors().select("code", F.col("id").alias("cheapest_competitor_id"))
    ours = products().select(F.col("sku").alias("product_sku"), F.col("current_price").alias("platform_price"))
    gap = pct_of(F.col("platform_price") - F.col("price"), F.col("platform_price"))
    # a cheapest competitor without a dimension row withdraws the product's summary
    return batch.join(theirs, F.col("competitor_code") == F.col("code"), "left").join(ours, "product_sku").select(
        "product_sku",
        "cheapest_competitor_id",
        F.col("price").alias("cheapest_price"),
        "platform_price",
        gap.try_cast("decimal(6,2)").alias("gap_pct"),
        "competitor_count",
        "in_stock_competitor_count",
        instant(as_of).alias("summary_timestamp"),
        "version",
        F.col("cheapest_competitor_id").isNull().alias("deleted"),
    )


def summary_table(path: str) -> KeyedTable:
    return KeyedTable(path, ("product_sku",), ("version",), deleted="deleted")


def summary_job(
    stream: DataFrame, products: DimReader, competitors: DimReader, table: KeyedTable, checkpoint: str, as_of, trigger: str | None = "30 seconds"
) -> StreamingQuery:
    """Prices to one market summary per product, a former cheapest taken back when it gets dearer.

    The latest price of every pair is kept beside the summary; a batch writes those it touches, then the skus it touches
    are summed up anew. A batch that runs again writes the same.
    """
    latest = KeyedTable(f"{table.path}/latest", ("product_sku", "competitor_name"), updating.LATEST)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            kept(latest, batch, batch_id, "summary")
            now = updating.cheapest_of(of_touched(latest, batch)).withColumn("version", F.lit(batch_id))
            table.upsert(summary_of(now, products, competitors, as_of), batch_id, "summary")
        finally:
            batch.unpersist()

    return start(updating.stream_latest_prices(stream), write, checkpoint, trigger, mode="update")


COMPACT_EVERY = 50


def kept(table: KeyedTable, rows: DataFrame, batch_id: int, writer: str) -> None:
    """Upsert a batch into a job's own table, folded from time to time so that reading it costs the same however many batches ran."""
    table.upsert(rows, batch_id, writer)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        table.compact(rows.sparkSession, batch_id)


def of_touched(table: KeyedTable, batch: DataFrame) -> DataFrame:
    """Current rows of the skus that a batch touches."""
    return table.read(batch.sparkSession).join(batch.select("product_sku").distinct(), "product_sku", "left_semi")


def pair_signals_of(batch: DataFrame, competitors: DimReader, settings: Settings = DEFAULTS) -> DataFrame:
    """For each of ``updating.repriced_pairs_of`` with a ``version`` and each row rule its signal, or a withdrawal where the rule no longer holds."""
    theirs = competitors().select("code", F.col("id").alias("competitor_id"))
    joined = batch.join(theirs, F.lower("competitor_name") == F.col("code")).drop("code")
    cases = signals.row_cases(settings)
    holds = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(cond, row).alias("row")) for k, (cond, row) in cases.items()])
    each = joined.withColumn("_c", F.explode(holds))
    return each.select(
        "product_sku",
        "competitor_id",
        F.col("_c.kind").alias("signal_type"),
        *[F.col(f"_c.row.{c}").alias(c) for c in ("platform_price", "competitor_price", "percentage_diff", "recommendation", "priority")],
        "in_stock",
        F.col("event_time").alias("signal_timestamp"),
        F.lit(True).alias("is_active"),
        "version",
        F.col("_c.row").isNull().alias("deleted"),
    )


def pair_signals_table(path: str) -> KeyedTable:
    return KeyedTable(path, tuple(signals.SIGNAL_KEY), ("version",), deleted="deleted")


def pair_signals_job(
    stream: DataFrame, changes: DataFrame, competitors: DimReader, table: KeyedTable, checkpoint: str, settings: Settings = DEFAULTS,
    trigger: str | None = "10 seconds",
) -> StreamingQuery:
    """Signals of every pair's latest price, re-evaluated when its product changes.

    Latest prices and newest product rows are kept beside the signals; a batch writes those it touches, then all pairs
    of the skus it touches are evaluated anew. A batch that runs again writes the same.
    """
    latest = KeyedTable(f"{table.path}/latest", ("product_sku", "competitor_name"), updating.LATEST)
    goods = KeyedTable(f"{table.path}/products", ("product_sku",), updating.CHANGE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            kept(latest, batch.filter("not is_change").select("product_sku", "competitor_name", "price.*"), batch_id, "pairs")
            kept(goods, batch.filter("is_change").select("product_sku", "product.*"), batch_id, "pairs")
            now = updating.repriced_pairs_of(of_touched(latest, batch), of_touched(goods, batch)).withColumn("version", F.lit(batch_id))
            table.upsert(pair_signals_of(now, competitors, settings), batch_id, "pairs")
        finally:
            batch.unpersist()

    return start(updating.stream_prices_and_changes(stream, changes), write, checkpoint, trigger, mode="update")


def dims_job(changes: DataFrame, tables: dict[str, tuple[KeyedTable, str]], checkpoint: str, trigger: str | None = "10 seconds") -> StreamingQuery:
    """One stream of changes of several tables to their keyed dimensions.

    ``changes`` as ``updating.stream_newest_changes`` takes them; ``tables`` gives each source's dimension and the DDL of its
    rows. Deletes leave tombstones, and an older change that arrives late changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for source, (table, ddl) in tables.items():
                own = batch.filter(F.col("source") == source)
                row = F.from_json("after", ddl)
                parsed = own.select("row_key", row.alias("r"), F.timestamp_micros("at").alias("op_ts"), (F.col("rank") == 2).alias("deleted"))
                table.upsert(parsed.select("row_key", "r.*", "op_ts", "deleted"), batch_id, "dims")
        finally:
            batch.unpersist()

    return start(updating.stream_newest_changes(changes), write, checkpoint, trigger, mode="update")


def change_table(path: str) -> KeyedTable:
    """A dimension that ``dims_job`` writes."""
    return KeyedTable(path, ("row_key",), ("op_ts", "deleted"), deleted="deleted")


def history_and_trends_job(
    stream: DataFrame, competitors: DimReader, history: str, trends: KeyedTable, checkpoint: str, trigger: str | None = "10 seconds"
) -> StreamingQuery:
    """Price history and five-minute trends from one read of the source: appended, and upserted by window."""

    def known(rows: DataFrame) -> DataFrame:
        codes = competitors().select("code", F.col("id").alias("competitor_id"))
        joined = updating.history_of(rows).join(codes, F.lower("competitor_name") == F.col("code"))
        return joined.select("product_sku", "competitor_id", "price", "in_stock", "source_sku", "data_timestamp", "collection_timestamp")

    outputs = [
        (known, lambda df, batch_id: append(df, history, batch_id)),
        (updating.trends_of, upsert_sink(trends, "trends")),
    ]
    return start(updating.stream_history_beside_trends(stream), fan_out(outputs, f"{checkpoint}/rows"), checkpoint, trigger)


def trends_table(path: str) -> KeyedTable:
    return KeyedTable(path, ("product_sku", "competitor_name", "window_start"), ("window_end",))


def upsert_sink(table: KeyedTable, writer: str = "main") -> BatchSink:
    """Upserts under the job's own name; every job that writes to a table needs another one."""
    return lambda df, batch_id: table.upsert(df, batch_id, writer)


def fan_out(outputs: Sequence[tuple[BatchOp, BatchSink]], place: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that feeds several outputs from one read of the source.

    Meanwhile the batch is kept by the executors, or in files at ``place``, which the next batch overwrites: files take
    a fraction of the disk and none of the memory, and a lost executor costs a re-read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if place:
            batch.write.mode("overwrite").option("compression", "zstd").parquet(place)
            rows = batch.sparkSession.read.schema(batch.schema).parquet(place)
        else:
            rows = batch.persist()
        try:
            for op, sink in outputs:
                sink(op(rows), batch_id)
        finally:
            if not place:
                batch.unpersist()

    return write


def start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "10 seconds",
    mode: str = "append",
) -> StreamingQuery:
    """Start a checkpointed query; without a trigger interval it handles what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
