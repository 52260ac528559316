"""Raw JSON envelopes to flat records, SKU mapping, lineage and the raw archive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import schemas


def _millis(iso: Column) -> Column:
    """ISO text to epoch milliseconds, NULL when it does not parse; text without offset is session-local."""
    return F.unix_millis(iso.try_cast("timestamp"))


def _parsed(raw: DataFrame, schema) -> DataFrame:
    """Parse the ``value`` text once per document.

    The text is named twice, so a text that is itself computed is computed beside the parser and not inside it, where
    expressions are interpreted.
    """
    text = F.col("value")
    doc = raw.select(F.when(text.isNotNull(), F.from_json(text, schema)).alias("d"), F.unix_millis("ingest_time").alias("ingest_ms"))
    return doc.select("d.*", "ingest_ms")


def _entries(source: str) -> Column:
    """A source map, or NULL for a document that is broken or names no product.

    Exploding NULL yields no row, which spares a filter that would parse the text twice.
    """
    return F.when(F.col("product.sku").isNotNull(), F.col(f"data_sources.{source}"))


def _filled(entry: Column, *fields: str) -> Column:
    """Whether an entry of a source map holds anything; an empty one parses to a struct of NULLs."""
    return reduce(or_, [entry[f].isNotNull() for f in fields])


def flatten_competitor_prices(raw: DataFrame) -> DataFrame:
    """One record per competitor of a market envelope; empty entries are skipped.

    When either timestamp does not parse, both fall back to the ingest time.
    """
    entries = _parsed(raw, schemas.market_envelope("competitors")).select(
        F.col("product.sku").alias("product_sku"),
        "collection_timestamp",
        "ingest_ms",
        F.explode(_entries("competitors")).alias("competitor_name", "quote"),
    )
    collected = F.when(F.col("collection_timestamp").isNull(), F.col("ingest_ms")).otherwise(
        _millis(F.col("collection_timestamp"))
    )
    dated = F.when(F.col("quote.data_timestamp").isNull(), F.col("_collected")).otherwise(_millis(F.col("quote.data_timestamp")))
    # named before they are used twice, so that each text is read once
    timed = entries.filter(_filled(F.col("quote"), "price", "in_stock", "sku", "data_timestamp")).withColumn("_collected", collected)
    timed = timed.withColumn("_dated", dated)
    both = F.col("_collected").isNotNull() & F.col("_dated").isNotNull()
    return timed.select(
        "product_sku",
        "competitor_name",
        F.col("quote.price").alias("price"),
        F.col("quote.in_stock").alias("in_stock"),
        F.col("quote.sku").alias("source_sku"),
        F.when(both, F.col("_collected")).otherwise(F.col("ingest_ms")).alias("api_collection_ts_ms"),
        F.when(both, F.col("_dated")).otherwise(F.col("ingest_ms")).alias("data_ts_ms"),
    )


def flatten_aggregator_prices(raw: DataFrame) -> DataFrame:
    """One record per price aggregator of a market envelope, empty entries skipped; each timestamp falls back on its own."""
    entries = _parsed(raw, schemas.market_envelope("aggregators")).select(
        F.col("product.sku").alias("product_sku"),
        "collection_timestamp",
        "ingest_ms",
        F.explode(_entries("aggregators")).alias("aggregator_name", "a"),
    )
    collected = F.coalesce(_millis(F.col("collection_timestamp")), F.col("ingest_ms"))
    return (
        entries.filter(_filled(F.col("a"), "available", "avg_price", "price_range", "stores_tracked", "data_last_updated"))
        .withColumn("api_collection_ts_ms", collected)
        .select(
            "product_sku",
            "aggregator_name",
            F.col("a.available").alias("available"),
            F.col("a.avg_price").alias("avg_price"),
            F.col("a.price_range.min").alias("min_price"),
            F.col("a.price_range.max").alias("max_price"),
            F.col("a.stores_tracked").alias("stores_tracked"),
            "api_collection_ts_ms",
            F.coalesce(_millis(F.col("a.data_last_updated")), F.col("api_collection_ts_ms")).alias(
                "data_last_updated_ts_ms"
            ),
            F.timestamp_millis("api_collection_ts_ms").alias("collection_timestamp"),
        )
    )


def flatten_user_behavior(raw: DataFrame) -> DataFrame:
    """Behaviour envelope to a flat event with source tags."""
    doc = _parsed(raw, schemas.BEHAVIOR_ENVELOPE).filter(F.col("product.sku").isNotNull())
    collected = F.coalesce(_millis(F.col("collection_timestamp")), F.col("ingest_ms"))
    return doc.select(
        "product.*",
        *[
            F.col(f"user_behavior.{c}")
            for c in (
                "page_views", "unique_visitors", "dwell_seconds", "searches", "cart_additions", "purchases",
                "price_comparisons",
            )
        ],
        collected.alias("api_collection_ts_ms"),
        F.coalesce(_millis(F.col("user_behavior.data_timestamp")), collected).alias("data_ts_ms"),
        F.lit("user_behavior_api").alias("collection_source"),
        F.lit("user_interaction").alias("data_type"),
    )


def map_source_skus(quotes: DataFrame, mapping: DataFrame, competitor_of: Mapping[str, str]) -> DataFrame:
    """Attach the universal sku to quotes that carry a competitor's own product id.

    ``mapping`` is wide (one id column per competitor); ``competitor_of`` names the
    competitor behind each id column.
    """
    pairs = mapping.select("universal_sku", *competitor_of).unpivot(
        ["universal_sku"], list(competitor_of), "_column", "source_sku"
    )
    names = F.create_map(*[F.lit(v) for item in competitor_of.items() for v in item])
    known = pairs.filter(F.col("source_sku").isNotNull()).select(
        "universal_sku", names[F.col("_column")].alias("competitor_name"), "source_sku"
    )
    return quotes.join(known, ["competitor_name", "source_sku"]).withColumnRenamed("universal_sku", "product_sku")


def with_lineage(records: DataFrame, topic: str, producer: str, key: Sequence[str], produced_at=None) -> DataFrame:
    """Producer stamp, message key, and a message id hashed from the content so replays keep it."""
    content = F.to_json(F.struct(*records.columns))
    stamp = F.current_timestamp() if produced_at is None else F.lit(produced_at).cast("timestamp")
    return records.select(
        "*",
        stamp.alias("producer_timestamp"),
        F.lit(f"{producer}-producer").alias("producer_id"),
        F.concat(F.lit(f"{topic}_"), F.sha2(content, 256)).alias("message_id"),
        F.concat_ws("_", *[F.col(c).cast("string") for c in key]).alias("message_key"),
    )


def archive_raw(messages: DataFrame) -> DataFrame:
    """Last write wins per message id."""
    rest = [c for c in messages.columns if c != "message_id"]
    return (
        messages.groupBy("message_id")
        .agg(F.max_by(F.struct(*rest), F.struct("ingest_time", "value")).alias("m"))
        .select("message_id", "m.*")
    )
