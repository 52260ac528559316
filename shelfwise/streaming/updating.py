"""State that takes rows back: market summary, signals under changing products, newest changes, history beside trends."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwise.functions.columns import tumbling
from shelfwise.streaming.ordered import _order, _plain

LATEST = ["at", "api_ms", "source_sku", "cents", "in_stock"]
LATEST_DDL = "at bigint, api_ms bigint, source_sku string, cents bigint, in_stock boolean"
WINDOW = 300_000_000


def _money(name: str):
    return (F.col(name).cast("decimal(12,0)") / F.lit(100)).cast("decimal(10,2)")


def _price_rows(stream: DataFrame) -> DataFrame:
    return stream.select(
        "product_sku",
        "competitor_name",
        F.unix_micros("event_time").alias("at"),
        F.col("api_collection_ts_ms").alias("api_ms"),
        "source_sku",
        (F.col("price") * 100).cast("bigint").alias("cents"),
        "in_stock",
    )


def _tuples(batch: pd.DataFrame, columns: list[str]) -> Iterator[tuple]:
    """Rows of whole numbers, texts and flags; pandas hands a column of numbers with nulls over as floats."""
    for row in zip(*(batch[c].tolist() for c in columns)):
        yield tuple(int(v) if isinstance(v, float) and v == v else _plain(v) for v in row)


class LatestPerCompetitor(StatefulProcessor):
    """A sku's cheapest latest price and its competitor counts, as they stand after each batch.

    State holds each competitor's latest price, so a dearer update takes back a former cheapest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "competitor_name string", LATEST_DDL)
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for batch in rows:
            for name, *row in _tuples(batch, ["competitor_name", *LATEST]):
                if name not in newest or _order(row[:4]) > _order(newest[name][:4]):
                    newest[name] = tuple(row)
        held = {k[0]: tuple(v) for k, v in self.latest.iterator()} if self.latest.exists() else {}
        for name, row in newest.items():
            if name not in held or _order(row[:4]) > _order(held[name][:4]):
                held[name] = row
                self.latest.updateValue((name,), row)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        cents, code = min((row[3], name.lower()) for name, row in held.items())
        stocked = sum(1 for row in held.values() if row[4])
        yield pd.DataFrame([(key[0], code, cents, len(held), stocked, version)], columns=["product_sku", "code", "cents", "n", "stocked", "version"])

    def close(self) -> None:
        pass


def stream_latest_prices(stream: DataFrame) -> DataFrame:
    """Latest price (``LATEST``) of each pair a batch touches: a running aggregate, in update mode."""
    newest = F.max(F.struct(*LATEST)).alias("r")
    return _price_rows(stream).groupBy("product_sku", "competitor_name").agg(newest).select("product_sku", "competitor_name", "r.*")


def cheapest_of(latest: DataFrame) -> DataFrame:
    """(product_sku, competitor_code, price, competitor_count, in_stock_competitor_count) of the latest prices of skus' pairs."""
    code = F.lower("competitor_name")
    per_sku = latest.groupBy("product_sku").agg(
        F.min(F.struct("cents", code.alias("code"))).alias("c"),
        F.count(F.lit(1)).cast("int").alias("competitor_count"),
        F.count(F.when(F.col("in_stock"), 1)).cast("int").alias("in_stock_competitor_count"),
    )
    return per_sku.select("product_sku", "c.*", "competitor_count", "in_stock_competitor_count").select(
        "product_sku", F.col("code").alias("competitor_code"), _money("cents").alias("price"), "competitor_count", "in_stock_competitor_count"
    )


PRODUCT = ["ours", "sensitivity", "we_stock", "is_active"]
CHANGE = ["op_at", "rank", *PRODUCT]
CHANGE_DDL = "op_at bigint, rank int, ours bigint, sensitivity string, we_stock boolean, is_active boolean"


class RepricedPairs(StatefulProcessor):
    """Two inputs keyed by sku: prices, and changes of the product. Either re-evaluates what it touches.

    State holds the newest product row by commit time (a delete leaves a tombstone) and each
    competitor's latest price. A price gives its pair; a product change gives all pairs of the sku.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "competitor_name string", LATEST_DDL)
        self.product = handle.getValueState("product", CHANGE_DDL)
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        change: tuple | None = None
        for batch in rows:
            for name, *row in _tuples(batch[batch["competitor_name"].notna()], ["competitor_name", *LATEST]):
                if name not in newest or _order(row[:4]) > _order(newest[name][:4]):
                    newest[name] = tuple(row)
            for row in _tuples(batch[batch["competitor_name"].isna()], ["op_at", "rank", *PRODUCT]):
                if change is None or _order(row) > _order(change):
                    change = row
        touched = []
        for name, row in newest.items():
            held = tuple(self.latest.getValue((name,))) if self.latest.containsKey((name,)) else None
            if held is None or _order(row[:4]) > _order(held[:4]):
                self.latest.updateValue((name,), row)
                touched.append((name, row))
        product = tuple(self.product.get()) if self.product.exists() else None
        if change is not None and (product is None or _order(change) > _order(product)):
            product = change
            self.product.update(change)
            touched = [(k[0], tuple(v)) for k, v in self.latest.iterator()]
        if product is None or not touched:
            return
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        gone = product[1] == 2
        fields = (None,) * len(PRODUCT) if gone else product[2:]
        out = pd.DataFrame([(key[0], name, *row, *fields, version) for name, row in touched], columns=["product_sku", "competitor_name", *LATEST, *PRODUCT, "version"])
        for c in ("ours", "api_ms"):
            out[c] = out[c].astype("Int64")
        for c in ("in_stock", "we_stock", "is_active"):
            out[c] = out[c].astype("boolean")
        yield out

    def close(self) -> None:
        pass


def stream_prices_and_changes(stream: DataFrame, changes: DataFrame) -> DataFrame:
    """Of each pair and each product a batch touches its latest price or newest change, as (is_change, product_sku, competitor_name, price, product).

    ``changes`` are captured changes of products (op, op_ts, before, after). One running aggregate over both, in update mode.
    """
    none = lambda ddl: F.lit(None).cast(ddl)
    price, product = f"struct<{LATEST_DDL}>", f"struct<{CHANGE_DDL}>"
    prices = _price_rows(stream).select(
        F.lit(False).alias("is_change"), "product_sku", "competitor_name", F.struct(*LATEST).alias("price"), none(product).alias("product")
    )
    newest = F.struct(
        F.unix_micros("op_ts").alias("op_at"),
        F.when(F.col("op") == "d", 2).when(F.col("op") == "u", 1).otherwise(0).alias("rank"),
        (F.col("after.current_price") * 100).cast("bigint").alias("ours"),
        F.col("after.price_sensitivity").alias("sensitivity"),
        F.col("after.in_stock").alias("we_stock"),
        F.col("after.is_active").alias("is_active"),
    )
    products = changes.select(
        F.lit(True).alias("is_change"),
        F.coalesce("after.sku", "before.sku").alias("product_sku"),
        none("string").alias("competitor_name"),
        none(price).alias("price"),
        newest.alias("product"),
    )
    both = prices.unionByName(products)
    return both.groupBy("is_change", "product_sku", "competitor_name").agg(F.max("price").alias("price"), F.max("product").alias("product"))


def repriced_pairs_of(latest: DataFrame, products: DataFrame) -> DataFrame:
    """Latest prices beside the newest product row; a pair whose product was deleted comes with null product fields."""
    here = lambda column: F.when(F.col("rank") != 2, column)
    return latest.join(products, "product_sku").select(
        "product_sku",
        "competitor_name",
        _money("cents").alias("price"),
        "in_stock",
        F.timestamp_micros("at").alias("event_time"),
        here(_money("ours")).alias("platform_price"),
        here(F.col("sensitivity")).alias("price_sensitivity"),
        here(F.col("we_stock")).alias("we_stock"),
        here(F.col("is_active")).alias("is_active"),
    )


class NewestChange(StatefulProcessor):
    """Changes of one row of one table, each passed on unless a newer one came before; deletes are remembered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at bigint, rank int, after string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.seen.get()) if self.seen.exists() else None
        best = held
        for batch in rows:
            for row in _tuples(batch, ["at", "rank", "after"]):
                if best is None or _order(row) > _order(best):
                    best = row
        if best != held:
            self.seen.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["source", "row_key", "at", "rank", "after"])

    def close(self) -> None:
        pass


def stream_newest_changes(changes: DataFrame) -> DataFrame:
    """Captured changes of several tables as (source, row_key, at, rank, after): the newest of each row a batch touches, in update mode.

    ``changes``: source (the table), row_key, op, op_ts and after (JSON text). Commit times may come in any
    order: where a newer change, or a delete, came before, that one is given again. A running aggregate: rows
    fold before they travel and no row passes through Python; ``NewestChange`` is the same for one key at a time.
    """
    rank = F.when(F.col("op") == "d", 2).when(F.col("op") == "u", 1).otherwise(0)
    newest = F.max(F.struct(F.unix_micros("op_ts").alias("at"), rank.alias("rank"), "after")).alias("r")
    return changes.groupBy("source", "row_key").agg(newest).select("source", "row_key", "r.*")


HISTORY = ["data_ms", "kafka_at", "source_sku", "cents", "in_stock", "api_ms"]
BESIDE_DDL = (
    "product_sku string, competitor_name string, is_history boolean, data_ms bigint, source_sku string, cents bigint, in_stock boolean, "
    "api_ms bigint, window_at bigint, n bigint, total bigint, spread double, opened bigint, closed bigint"
)


class HistoryBesideTrends(StatefulProcessor):
    """A pair's deduplicated prices and five-minute trends, from one read of the source.

    State is bounded by the watermark: the sums of each open window, and of each data time in it
    the record with the newest broker time. A window has one timer, at its end; its trend and its
    records leave together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState(
            "windows", "start bigint", "n bigint, total bigint, squares string, first_at bigint, opened bigint, last_at bigint, closed bigint"
        )
        self.records = handle.getMapState(
            "records", "start bigint", "data_ms array<bigint>, kafka_at array<bigint>, source_sku array<string>, cents array<bigint>, in_stock array<boolean>, api_ms array<bigint>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[tuple]] = {}
        for batch in rows:
            for at, *row in _tuples(batch, ["at", *HISTORY]):
                fresh.setdefault(at // WINDOW * WINDOW, []).append((at, *row))
        for start, group in fresh.items():
            if self.windows.containsKey((start,)):
                n, total, squares, first_at, opened, last_at, closed = self.windows.getValue((start,))
            else:
                n, total, squares, first_at, opened, last_at, closed = 0, 0, 0, None, None, None, None
                self.handle.registerTimer((start + WINDOW) // 1000)
            squares = int(squares)
            for at, _, _, _, cents, _, _ in group:
                n, total, squares = n + 1, total + cents, squares + cents * cents
                if first_at is None or (at, -cents) < (first_at, -opened):
                    first_at, opened = at, cents
                if last_at is None or (at, cents) > (last_at, closed):
                    last_at, closed = at, cents
            # squares may outgrow a long and is kept as text
            self.windows.updateValue((start,), (n, total, str(squares), first_at, opened, last_at, closed))
            held = {}
            if self.records.containsKey((start,)):
                held = {r[0]: r for r in zip(*self.records.getValue((start,)))}
            for row in (r[1:] for r in group if r[1] is not None):
                if row[0] not in held or _order(row[1:5]) > _order(held[row[0]][1:5]):
                    held[row[0]] = row
            if held:
                self.records.updateValue((start,), tuple(list(c) for c in zip(*held.values())))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 - WINDOW
        if not self.windows.containsKey((start,)):
            return
        n, total, squares, _, opened, _, closed = self.windows.getValue((start,))
        spread = float(max(n * int(squares) - total * total, 0))
        out = [(*key, False, None, None, None, None, None, start, n, total, spread, opened, closed)]
        if self.records.containsKey((start,)):
            for data_ms, _, source, cents, stock, api in zip(*self.records.getValue((start,))):
                out.append((*key, True, data_ms, source, cents, stock, api, start, None, None, None, None, None))
            self.records.removeKey((start,))
        self.windows.removeKey((start,))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in BESIDE_DDL.split(", ")])
        for c in ("data_ms", "cents", "api_ms", "n", "total", "opened", "closed"):
            frame[c] = frame[c].astype("Int64")
        frame["in_stock"] = frame["in_stock"].astype("boolean")
        yield frame

    def close(self) -> None:
        pass


def stream_history_beside_trends(stream: DataFrame) -> DataFrame:
    """Per pair, five-minute window and data time: the newest broker record and the moments of all records, once the watermark closes the window.

    A watermarked aggregate: rows fold before they travel and none passes through Python. All rows of a window leave in
    one batch, so ``history_of`` and ``trends_of`` read them as they are; ``HistoryBesideTrends`` is the same for one key at a time.
    Event time is the data time where there is one, so a group has one time and its dearest price says how it opens and
    closes; ``missing`` tells of prices that are null, which come first. Other times stand as their distance to the data
    time, which takes a fraction of the space in the shuffle and the state.
    """
    cents = (F.col("price") * 100).cast("bigint")
    wide = cents.cast("decimal(19,0)")
    timed = F.col("data_ts_ms").isNotNull()
    waited = F.unix_micros("kafka_ts") - F.col("data_ts_ms") * 1000
    record = F.struct(
        waited.alias("kafka_after"), "source_sku", cents.alias("cents"), "in_stock", (F.col("api_collection_ts_ms") - F.col("data_ts_ms")).alias("api_after")
    )
    return (
        stream.groupBy(
            "product_sku", "competitor_name", tumbling(F.col("event_time")).alias("w"), F.col("data_ts_ms").alias("data_ms"),
            F.when(~timed, F.unix_micros("event_time")).alias("untimed_at"),
        )
        .agg(
            F.max(F.when(timed, record)).alias("newest"),
            F.count(cents).alias("n"),
            F.sum(cents).alias("total"),
            F.sum(wide * wide).alias("squares"),
            F.max(cents).alias("dearest"),
            F.max(cents.isNull()).alias("missing"),
        )
    )


def history_of(rows: DataFrame) -> DataFrame:
    """Deduplicated price records of a batch of ``stream_history_beside_trends``."""
    return rows.filter("data_ms is not null").select("product_sku", "competitor_name", "data_ms", "newest.*").select(
        "product_sku",
        "competitor_name",
        _money("cents").alias("price"),
        "in_stock",
        "source_sku",
        F.timestamp_millis("data_ms").alias("data_timestamp"),
        F.timestamp_millis(F.col("data_ms") + F.col("api_after")).alias("collection_timestamp"),
    )


def trends_of(rows: DataFrame) -> DataFrame:
    """Five-minute trends of a batch of ``stream_history_beside_trends``."""
    key = ["product_sku", "competitor_name", "window_start"]
    at = F.coalesce(F.col("data_ms") * 1000, "untimed_at").alias("at")
    several = [F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("total", "squares")]
    moments = rows.select("product_sku", "competitor_name", F.col("w.start").alias("window_start"), at, "n", *several, "dearest", "missing")
    one = F.col("dearest").cast("decimal(19,0)")
    sums = {"n": F.col("n"), "total": F.coalesce("total", "dearest"), "squares": F.coalesce("squares", one * one)}
    # few rows of a window fold, so they travel as they are, once: the table the trends go to has the same key
    whole = moments.repartition(*key).groupBy(*key).agg(
        *[F.sum(value).cast("decimal(38,0)").alias(c) for c, value in sums.items()],
        F.min(F.struct("at", F.when(~F.col("missing"), -F.col("dearest")).alias("cents"))).alias("opened"),
        F.max(F.struct("at", F.col("dearest").alias("cents"))).alias("closed"),
    )
    # a window whose prices are all null has neither average nor deviation
    whole = whole.withColumn("n", F.nullif("n", F.lit(0)))
    n, total, exact = F.col("n").cast("decimal(20,0)"), F.col("total").cast("decimal(20,0)"), F.col("total").cast("decimal(19,0)")
    spread = (F.col("n").cast("decimal(10,0)") * F.col("squares").cast("decimal(27,0)") - exact * exact).cast("double")
    average = F.round(F.round(total / n / F.lit(100), 6), 2).cast("decimal(10,2)")
    deviation = (F.round(F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("n").cast("double")) / 100).try_cast("decimal(5,2)")
    first, last = -F.col("opened.cents"), F.col("closed.cents")
    direction = F.when(first < last, "up").when(first > last, "down").otherwise("stable")
    return whole.select(
        "product_sku",
        "competitor_name",
        "window_start",
        (F.col("window_start") + F.expr("interval 5 minutes")).alias("window_end"),
        average.alias("avg_price"),
        deviation.alias("price_volatility"),
        direction.alias("trend_direction"),
    )
