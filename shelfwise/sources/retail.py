"""Retail tables derived by Spark from a TPC-H-like star schema.

Every table below reads the whole of its input: a product is a family of ten consecutive
parts, a competitor is a chain of suppliers, price records come from order lines, shopper
behaviour from events, and price changes, proposals and observations from orders. Money is
computed in integer cents so that any engine gives the same values.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS
from shelfwise.functions.columns import sensitivity_label
from shelfwise.operators import behavior, demand, forecast, market, prices, signals
from shelfwise.sources.streams import with_watermark
from shelfwise.sources.tables import read_table

# Key to spread a table by when its files give fewer splits than there are cores.

AS_OF = "2024-01-04 00:00:00"
T0_MS = 1704067200000  # 2024-01-01 00:00:00 UTC


def sku_of(key: Column) -> Column:
    return F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 12, "0"))


def money(cents: Column) -> Column:
    """Cents as money; a product of narrow decimals, which costs a fraction of a division."""
    return (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")


def at_minute(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(T0_MS // 1000) + minutes * 60)


def before_as_of(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(T0_MS // 1000 + 3 * 86400) - seconds)


class RetailTables:
    """Lazily derived domain tables over one folder of Parquet inputs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    # ---- dimensions -------------------------------------------------------------

    @cached_property
    def _families(self) -> DataFrame:
        family = self.raw("part").groupBy(F.expr("p_partkey div 10").alias("k")).agg(
            F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("total"),
            F.count(F.lit(1)).alias("variants"),
            F.sum("p_size").alias("size"),
            F.max_by("p_name", "p_partkey").alias("name"),
            F.max_by("p_type", "p_partkey").alias("category"),
            F.max_by("p_brand", "p_partkey").alias("brand"),
        )
        return family.withColumn("cents", F.expr("total div variants"))

    @cached_property
    def products(self) -> DataFrame:
        k, size = F.col("k"), F.col("size")
        label = F.when(size % 4 == 0, "high").when(size % 4 == 1, "medium").when(size % 4 == 2, "low")
        return self._families.select(
            sku_of(k).alias("sku"),
            "name",
            "category",
            "brand",
            money(F.expr("cents * 80 div 100")).alias("cost"),
            F.when(k % 3 != 0, money(F.expr("cents * 85 div 100"))).alias("min_viable_price"),
            money(F.col("cents")).alias("current_price"),
            label.alias("price_sensitivity"),
            F.when(k % 4 != 3, (-(k % 4) * 6 / F.lit(10)).cast("decimal(6,3)")).alias("price_elasticity"),
            F.when(label.isNotNull(), before_as_of((k % 48) * 3600)).alias("sensitivity_last_updated"),
            (size % 200).cast("int").alias("sensitivity_observations"),
            (size % 10 != 0).alias("in_stock"),
            (size % 13 != 0).alias("is_active"),
            F.lit("2023-12-01 00:00:00").cast("timestamp").alias("created_at"),
            F.when(k % 2 != 0, before_as_of((k % 30) * 86400)).alias("updated_at"),
        )

    @cached_property
    def competitors(self) -> DataFrame:
        chain = self.raw("supplier").groupBy((F.col("s_suppkey") % 5).alias("id")).agg(F.min("s_name").alias("name"))
        # the last chain carries a code that no stream name lowers to, so its records find no dimension row
        code = F.when(F.col("id") == 4, F.concat(F.lit("chain-"), F.lower("name"))).otherwise(F.lower("name"))
        return chain.select(
            "id",
            "name",
            code.alias("code"),
            F.concat(F.lit("https://shop.example/"), F.col("id").cast("string")).alias("website"),
            F.lit(True).alias("is_active"),
            F.lit("2023-11-01 00:00:00").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def _cents(self) -> DataFrame:
        """Price of each product in cents, by sku and by the number in it: rows meet by number, and the text is written once a product."""
        price = money(F.col("cents"))
        return self._families.select("k", sku_of(F.col("k")).alias("sku"), (price * 100).cast("bigint").alias("cents"))

    # ---- streams as tables ------------------------------------------------------

    @cached_property
    def prices(self) -> DataFrame:
        ts_ms = F.expr(
            f"{T0_MS} + 1000 * ((7919 * l_orderkey + 104729 * l_partkey + 31 * l_linenumber) % 259200)"
        )
        factor = (
            F.lit(850)
            + F.round(F.col("l_discount") * 100).cast("bigint") * 20
            + F.round(F.col("l_tax") * 100).cast("bigint") * 10
            + F.col("l_linenumber") * 5
        )
        lines = self.raw("lineitem").select(
            F.expr("l_partkey div 10").alias("k"),
            F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") % 5).cast("string"), 9, "0")).alias(
                "competitor_name"
            ),
            factor.alias("factor"),
            (F.col("l_returnflag") != "R").alias("in_stock"),
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("source_sku"),
            (ts_ms + F.col("l_linenumber") * 1000).alias("api_collection_ts_ms"),
            F.when(F.col("l_quantity") != 50, ts_ms).alias("data_ts_ms"),
        )
        # the filter drops nothing; stated here, every reader of the rows has it and they can share a shuffle
        records = lines.join(self._cents.filter(F.col("sku").isNotNull()), "k").select(
            F.col("sku").alias("product_sku"),
            "competitor_name",
            money(F.expr("cents * factor div 1000")).alias("price"),
            "in_stock",
            "source_sku",
            "api_collection_ts_ms",
            "data_ts_ms",
            F.timestamp_millis(F.col("api_collection_ts_ms") + 1000).alias("kafka_ts"),
        )
        return prices.with_event_time(records)

    @cached_property
    def behavior(self) -> DataFrame:
        kk = F.get_json_object("props", "$.k").cast("bigint")
        events = self.raw("events").select(
            "*",
            kk.alias("kk"),
            (
                F.lit(T0_MS)
                + F.expr(f"(unix_micros(cast(ts as timestamp)) - {T0_MS * 1000}) div 10000")
            ).alias("data_ts_ms"),
        )
        flat = events.select(
            sku_of(F.col("user_id")).alias("sku"),
            F.concat(F.lit("Item "), F.col("user_id").cast("string")).alias("title"),
            F.col("event_type").alias("category"),
            (F.lit(10) + F.col("kk") % 20).alias("unique_visitors"),
            (F.lit(100) + F.col("kk")).alias("page_views"),
            F.when(F.col("event_type") != "error", (F.col("kk") * 7) % 60).alias("searches"),
            ((F.col("kk") * 3) % 15).alias("cart_additions"),
            (F.col("kk") % 5).alias("purchases"),
            (F.col("kk") % 30).alias("price_comparisons"),
            F.col("value").alias("dwell_seconds"),
            (F.col("data_ts_ms") + (F.col("kk") % 30) * 1000).alias("api_collection_ts_ms"),
            "data_ts_ms",
        )
        return flat.withColumn("event_time", F.timestamp_millis("data_ts_ms"))

    # ---- raw envelopes and change events ----------------------------------------

    @cached_property
    def market_envelopes(self) -> DataFrame:
        """One JSON document per (sku, collection minute) with a competitor and an aggregator map."""
        minute = F.expr("api_collection_ts_ms div 60000")
        iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        # the number leads the groups because rows are sorted by them, and skus begin alike
        key = ["_hash", "product_sku", "minute"]
        placed = self.prices.withColumn("minute", minute).withColumn("_hash", F.xxhash64("product_sku", "minute"))
        quotes = (
            placed.groupBy(*key, "competitor_name")
            .agg(
                F.min_by(
                    F.struct("price", "in_stock", "source_sku", "data_ts_ms"), F.struct("price", "source_sku")
                ).alias("q"),
                F.min("price").alias("lo"),
                F.max("price").alias("hi"),
                F.count(F.lit(1)).alias("n"),
            )
            .groupBy(*key)
            .agg(
                F.collect_list(
                    F.struct(
                        F.col("competitor_name").alias("key"),
                        F.struct(
                            F.col("q.price").alias("price"),
                            F.col("q.in_stock").alias("in_stock"),
                            F.col("q.source_sku").alias("sku"),
                            iso(F.col("q.data_ts_ms")).alias("data_timestamp"),
                        ).alias("value"),
                    )
                ).alias("entries"),
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
                F.sum("n").cast("int").alias("n"),
            )
        )
        # a shop and an aggregator that answered with an empty document
        vacant = F.struct(
            F.lit("vacant").alias("key"),
            F.struct(
                F.lit(None).cast("decimal(10,2)").alias("price"),
                F.lit(None).cast("boolean").alias("in_stock"),
                F.lit(None).cast("string").alias("sku"),
                F.lit(None).cast("string").alias("data_timestamp"),
            ).alias("value"),
        )
        doc = F.struct(
            F.struct(F.col("product_sku").alias("sku")).alias("product"),
            F.struct(
                F.map_from_entries(F.concat("entries", F.array(vacant))).alias("competitors"),
                F.map_from_arrays(
                    F.array(F.lit("pricewatch"), F.lit("idlewatch"), F.lit("emptywatch")),
                    F.array(
                        F.struct(
                            F.lit(True).alias("available"),
                            F.col("lo").alias("avg_price"),
                            F.struct(F.col("lo").alias("min"), F.col("hi").alias("max")).alias("price_range"),
                            F.col("n").alias("stores_tracked"),
                        ),
                        F.lit(None).cast(
                            "struct<available:boolean,avg_price:decimal(10,2),"
                            "price_range:struct<min:decimal(10,2),max:decimal(10,2)>,stores_tracked:int>"
                        ),
                        F.struct(
                            F.lit(None).cast("boolean").alias("available"),
                            F.lit(None).cast("decimal(10,2)").alias("avg_price"),
                            F.lit(None).cast("struct<min:decimal(10,2),max:decimal(10,2)>").alias("price_range"),
                            F.lit(None).cast("int").alias("stores_tracked"),
                        ),
                    ),
                ).alias("aggregators"),
            ).alias("data_sources"),
            iso(F.col("minute") * 60000).alias("collection_timestamp"),
            F.lit("external_market_data_only").alias("collection_status"),
        )
        return quotes.select(
            F.to_json(doc).alias("value"), F.timestamp_millis(F.col("minute") * 60000 + 1000).alias("ingest_time")
        )

    @cached_property
    def behavior_envelopes(self) -> DataFrame:
        iso = F.date_format(F.timestamp_millis("data_ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        doc = F.struct(
            F.struct("sku", "title", "category").alias("product"),
            F.struct(
                "page_views", "unique_visitors", "dwell_seconds", "searches", "cart_additions", "purchases",
                "price_comparisons", iso.alias("data_timestamp"),
            ).alias("user_behavior"),
            F.lit("internal_platform").alias("data_source"),
        )
        return self.behavior.select(
            F.to_json(doc).alias("value"), F.timestamp_millis("api_collection_ts_ms").alias("ingest_time")
        )

    @cached_property
    def product_changes(self) -> DataFrame:
        """Snapshot reads of every product, then one update or delete per price record."""
        row = F.struct(*self.products.columns)
        snapshot = self.products.select(
            F.lit("r").alias("op"),
            F.lit("2023-12-31 00:00:00").cast("timestamp").alias("op_ts"),
            F.lit(None).cast(self.products.select(row.alias("r")).schema["r"].dataType).alias("before"),
            row.alias("after"),
        )
        edits = self.prices.select(
            F.col("product_sku").alias("sku"),
            F.col("price").alias("new_price"),
            F.col("kafka_ts").alias("op_ts"),
            (~F.col("in_stock") & (F.col("api_collection_ts_ms") % 2000 == 0)).alias("gone"),
        ).join(self.products, "sku")
        changed = F.struct(
            *[F.col("new_price").alias(c) if c == "current_price" else F.col(c) for c in self.products.columns]
        )
        updates = edits.select(
            F.when(F.col("gone"), "d").otherwise("u").alias("op"),
            "op_ts",
            row.alias("before"),
            F.when(~F.col("gone"), changed).alias("after"),
        )
        return snapshot.unionByName(updates)

    # ---- stored tables from the pipeline ----------------------------------------

    @cached_property
    def history(self) -> DataFrame:
        return prices.competitor_price_history(self.prices, self.competitors)

    @cached_property
    def trends(self) -> DataFrame:
        return prices.price_trends(self.prices)

    @cached_property
    def signals(self) -> DataFrame:
        return signals.current_signals(self.prices, self.products, self.competitors, as_of=AS_OF)

    @cached_property
    def movements(self) -> DataFrame:
        return signals.price_movements(self.prices, self.products, self.competitors)

    @cached_property
    def summary(self) -> DataFrame:
        return market.product_market_summary(self.prices, self.products, self.competitors, as_of=AS_OF)

    @cached_property
    def behavior_summary(self) -> DataFrame:
        return behavior.behavior_summary(self.behavior)

    @cached_property
    def dvs(self) -> DataFrame:
        return demand.demand_vs_signals(self.behavior_summary, self.signals)

    @cached_property
    def features(self) -> DataFrame:
        windows = forecast.history_windows(self.history, as_of=AS_OF, days=14)
        return forecast.forecast_features(windows)

    # ---- stored tables from orders ----------------------------------------------

    @property
    def _orders(self) -> DataFrame:
        return self.raw("orders").select(
            "*", sku_of(F.expr("o_custkey div 10")).alias("sku"), F.col("o_orderkey").alias("id")
        )

    @cached_property
    def price_history(self) -> DataFrame:
        return self._orders.join(self._cents.drop("k"), "sku").select(
            "sku",
            money(F.col("cents")).alias("old_price"),
            money(F.expr("cents * (95 + id % 10) div 100")).alias("adjusted_price"),
            F.lit("proposal_apply").alias("change_type"),
            F.lit("price-applier").alias("changed_by"),
            F.lit(None).cast("string").alias("source"),
            F.lit(None).cast("string").alias("reason_code"),
            at_minute((F.col("id") * 37) % 4320).alias("change_timestamp"),
            F.lit(None).cast("string").alias("notes"),
            F.col("id").alias("proposal_id"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        step = F.col("id") % 50
        k = F.expr("o_custkey div 40")
        return self._orders.select(
            sku_of(k).alias("sku"),
            before_as_of((F.col("id") * 7919) % 360000).alias("observed_at"),
            money(F.lit(90000) + step * 200).alias("price"),
            F.when(F.col("id") % 101 == 0, 0).otherwise(F.lit(1000) - step * (k % 5)).cast("int").alias("demand"),
        )

    @cached_property
    def sensitivity(self) -> DataFrame:
        e = -(F.col("id") % 250) / F.lit(100.0)
        return self._orders.select(
            "sku",
            e.alias("price_elasticity"),
            sensitivity_label(e).alias("price_sensitivity"),
            (F.lit(20) + F.col("id") % 180).cast("int").alias("observations"),
            before_as_of((F.col("id") % 1000) * 3600).alias("updated_at"),
        )

    @cached_property
    def proposals(self) -> DataFrame:
        i = F.col("id")
        created = (i * 37) % 20160 * 60
        cents = F.col("cents")
        old = F.when(i % 23 == 0, F.lit(None)).when(i % 3 != 0, cents).otherwise(F.expr("cents * 97 div 100"))
        status = F.element_at(
            F.array(*[F.lit(s) for s in ("pending", "approved", "approved", "applied", "rejected")]),
            (i % 5 + 1).cast("int"),
        )
        reason = F.when(i % 2 == 0, "elasticity+forecast").otherwise("elasticity-only")
        return self._orders.join(self._cents.drop("k"), "sku").select(
            "id",
            "sku",
            money(old).alias("old_price"),
            money(F.expr("cents * (95 + id % 11) div 100")).alias("proposed_price"),
            F.lit(-1.0).cast("decimal(6,3)").alias("elasticity_used"),
            F.when(i % 13 != 0, (i % 40 - 20) / F.lit(8.0)).alias("expected_demand_delta"),
            F.when(i % 17 != 0, (i % 90 - 30) / F.lit(4.0)).alias("expected_profit_delta"),
            F.when(i % 2 == 0, F.lit(-0.01)).cast("decimal(6,2)").alias("competitor_gap_after"),
            (F.lit(100) + i % 50).cast("double").alias("score"),
            reason.alias("reason_code"),
            F.lit("{}").alias("constraints"),
            status.alias("status"),
            F.when(i % 4 == 0, before_as_of(created - (i % 7 - 3) * 86400)).alias("effective_from"),
            F.when(i % 6 == 0, before_as_of(created - 2 * 86400)).alias("expires_at"),
            (i % 60).alias("run_id"),
            before_as_of(created).alias("created_at"),
            F.lit("price-proposer").alias("created_by"),
            F.when((status == "approved") & (i % 2 == 0), before_as_of(created - 300)).alias("approved_at"),
            F.lit(None).cast("string").alias("approved_by"),
            F.lit(None).cast("timestamp").alias("applied_at"),
            F.when(i % 9 == 0, "seen").alias("notes"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """One pricing run per order date, its counts taken from that day's orders."""
        day = F.expr("datediff(date'2001-12-31', to_date(o_orderdate))")
        daily = self.raw("orders").groupBy(day.alias("d")).agg(
            F.count(F.lit(1)).cast("int").alias("candidates_count"),
            F.count(F.when(F.col("o_orderstatus") != "F", 1)).cast("int").alias("proposed_count"),
        )
        params = F.when(
            F.col("d") % 2 == 0, F.lit('{"price_grid_pct":0.05,"target_undercut_pct":0.01,"other":1}')
        ).otherwise(F.lit('{"price_grid_pct":0.05}'))
        return daily.select(
            F.col("d").cast("bigint").alias("id"),
            before_as_of(F.col("d") * 3600).alias("started_at"),
            before_as_of(F.col("d") * 3600 - 300).alias("finished_at"),
            params.alias("parameters"),
            "candidates_count",
            "proposed_count",
            F.lit("price-proposer").alias("created_by"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        pairs = self.raw("lineitem").groupBy(
            F.expr("l_partkey div 10").alias("k"), (F.col("l_suppkey") % 5).alias("competitor_id")
        ).agg(F.count(F.lit(1)).alias("n"))
        n = F.col("n")
        mae = (n % 10) / F.lit(10.0)
        base = (F.lit(1) + n % 7) / F.lit(10.0)
        return pairs.select(
            sku_of(F.col("k")).alias("sku"),
            "competitor_id",
            F.lit(1).alias("horizon"),
            F.lit(900.0).alias("prediction"),
            F.lit(901.0).alias("last_price"),
            (n - 5).cast("int").alias("n_samples"),
            F.lit(0.001).alias("alpha"),
            mae.alias("cv_mae"),
            (mae * 2).alias("cv_rmse"),
            F.lit(0.5).alias("cv_r2"),
            base.alias("baseline_mae"),
            F.greatest(F.lit(0.0), F.lit(1.0) - mae / base).alias("confidence"),
            ((mae <= 0.5) & (F.lit(1.0) - mae / base >= 0.2)).alias("reliable"),
            before_as_of((F.col("k") * 5 + F.col("competitor_id")) * 60).alias("created_at"),
        )


class RetailStreams(RetailTables):
    """The same tables with order lines and events read as streams; dimensions stay batch tables."""

    STREAMED = ("lineitem", "events")

    def raw(self, name: str) -> DataFrame:
        if name not in self.STREAMED:
            return super().raw(name)
        path = f"{self.folder}/{name}*.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(path)

    @cached_property
    def marked_prices(self) -> DataFrame:
        return with_watermark(self.prices, "event_time", DEFAULTS.price_watermark)

    @cached_property
    def marked_behavior(self) -> DataFrame:
        return with_watermark(self.behavior, "event_time", DEFAULTS.behavior_watermark)
