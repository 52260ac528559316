"""Declared schemas of the streams, envelopes and change events, as DDL text."""

from __future__ import annotations


COMPETITOR_PRICE = (
    "product_sku string, competitor_name string, price decimal(10,2), in_stock boolean, source_sku string, "
    "api_collection_ts_ms bigint, data_ts_ms bigint"
)

USER_BEHAVIOR = (
    "sku string, title string, category string, unique_visitors bigint, page_views bigint, searches bigint, "
    "cart_additions bigint, purchases bigint, price_comparisons bigint, dwell_seconds double, "
    "api_collection_ts_ms bigint, data_ts_ms bigint, collection_source string, producer_timestamp string"
)

SOURCE_MAPS = {
    "competitors": "map<string,struct<price:decimal(10,2),in_stock:boolean,sku:string,url:string,data_timestamp:string>>",
    "aggregators": "map<string,struct<aggregator:string,available:boolean,avg_price:decimal(10,2),"
    "price_range:struct<min:decimal(10,2),max:decimal(10,2)>,stores_tracked:int,url:string,last_updated:string,"
    "data_last_updated:string>>",
}


def market_envelope(*sources: str) -> str:
    """A market envelope with these source maps; a reader of one need not build the other."""
    maps = ",".join(f"{name}:{SOURCE_MAPS[name]}" for name in sources)
    return (
        f"product struct<sku:string,title:string,category:string>, data_sources struct<{maps}>, "
        "collection_timestamp string, collection_status string"
    )


MARKET_ENVELOPE = market_envelope(*SOURCE_MAPS)

BEHAVIOR_ENVELOPE = (
    "product struct<sku:string,title:string,category:string>, "
    "user_behavior struct<page_views:bigint,unique_visitors:bigint,dwell_seconds:double,searches:bigint,"
    "cart_additions:bigint,purchases:bigint,price_comparisons:bigint,data_timestamp:string>, "
    "data_source string, collection_timestamp string"
)

PRODUCT = (
    "sku string, name string, category string, brand string, cost decimal(10,2), min_viable_price decimal(10,2), "
    "current_price decimal(10,2), price_sensitivity string, price_elasticity decimal(6,3), "
    "sensitivity_last_updated timestamp, sensitivity_observations int, in_stock boolean, is_active boolean, "
    "created_at timestamp, updated_at timestamp"
)

COMPETITOR = (
    "id bigint, name string, code string, website string, is_active boolean, created_at timestamp"
)

PRICE_SIGNAL = (
    "product_sku string, competitor_id bigint, signal_type string, platform_price decimal(10,2), "
    "competitor_price decimal(10,2), percentage_diff decimal(5,2), recommendation string, priority smallint, "
    "in_stock boolean, signal_timestamp timestamp, is_active boolean"
)

BEHAVIOR_SUMMARY = (
    "product_sku string, window_start timestamp, window_end timestamp, page_views bigint, unique_visitors bigint, "
    "searches bigint, cart_additions bigint, purchases bigint, price_comparisons bigint, search_rate double, "
    "search_cart_rate double, cart_purchase_rate double, view_compare_rate double, avg_dwell_seconds double"
)

def change_event(row: str) -> str:
    """Envelope of a captured row change: operation, commit time, row before and after."""
    return f"op string, op_ts timestamp, before struct<{row}>, after struct<{row}>"
