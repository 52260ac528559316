"""Hand fixtures for the rules that tables of ordinary data rarely reach."""

import datetime as dt
import json
import math
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from shelfwise.config import Settings
from shelfwise import schemas
from shelfwise.operators import behavior, demand, dims, elasticity, forecast, ingest, market, prices, proposals, signals
from shelfwise.plans import adjustments, overview, price_signals, price_trends

NOW = "2024-01-04 00:00:00"
PRICE = (
    "product_sku string;competitor_name string;price decimal(10,2);in_stock boolean;source_sku string;"
    "api_collection_ts_ms bigint;data_ts_ms bigint;kafka_ts timestamp"
)
PRODUCT = "sku string;current_price decimal(10,2);price_sensitivity string;in_stock boolean;is_active boolean"
RIVAL = "id bigint;name string;code string"
T = 1704067200000


@pytest.fixture
def price(frame):
    def make(rows):
        return prices.with_event_time(
            frame([(s, c, p, st, src, T + api * 1000, None if d is None else T + d * 1000, k) for s, c, p, st, src, api, d, k in rows], PRICE)
        )

    return make


@pytest.fixture
def rivals(frame):
    return frame([(1, "Amazon", "amazon"), (2, "eBay", "ebay"), (3, "Best Buy", "bestbuy")], RIVAL)


def test_dedup_keeps_newest_broker_record(price, rivals):
    df = price(
        [("a", "Amazon", 10, True, "x", 1, 0, "2024-01-01 00:00:02"), ("a", "Amazon", 11, True, "x", 1, 0, "2024-01-01 00:00:09"),
         ("a", "Amazon", 12, True, "x", 1, None, "2024-01-01 00:00:03"), ("a", "Best Buy", 12, True, "x", 1, 5, "2024-01-01 00:00:03")]
    )
    got = prices.dedup_prices(df)
    assert sorted(r["price"] for r in got.collect()) == [D("11.00"), D("12.00")]
    again = prices.dedup_prices(got)
    assert sorted(map(tuple, again.select(*got.columns).collect())) == sorted(map(tuple, got.collect()))
    # "best buy" is not the code "bestbuy": only the stream side is lowered
    assert prices.competitor_price_history(df, rivals).count() == 1


def test_event_time_falls_back(price):
    df = price([("a", "x", 1, True, "s", 7, None, "2024-01-01 00:01:00"), ("a", "x", 1, True, "s", 7, 3, "2024-01-01 00:01:00")])
    assert [str(r[0]) for r in df.select(F.col("event_time").cast("string")).collect()] == ["2024-01-01 00:00:07", "2024-01-01 00:00:03"]


def test_trend_ties_and_window_edge(price):
    df = price(
        [("a", "x", 10, True, "1", 0, 0, NOW), ("a", "x", 12, True, "2", 0, 0, NOW), ("a", "x", 12, True, "3", 0, 299, NOW),
         ("a", "x", 9, True, "4", 0, 300, NOW)]
    )
    got = {str(r["window_start"]): r for r in prices.price_trends(df).collect()}
    first = got["2024-01-01 00:00:00"]
    assert first["trend_direction"] == "stable"  # the higher of the two opening prices counts
    assert first["avg_price"] == D("11.33") and first["price_volatility"] == D("0.94")
    assert got["2024-01-01 00:05:00"]["avg_price"] == D("9.00")


def test_signals_guard_zero_price_and_overflow(price, rivals, frame):
    shop = frame([("z", 0, "high", True, True), ("c", 1, None, True, True)], PRODUCT)
    df = price([("z", "amazon", 5, True, "1", 0, 0, NOW), ("c", "amazon", 50, True, "2", 0, 0, NOW)])
    got = signals.overpriced_signals(df, shop, rivals).collect()
    assert [(r["product_sku"], r["percentage_diff"], r["priority"]) for r in got] == [("c", None, 3)]
    assert got[0]["recommendation"] == "Competitive: 4900.0000000000000% cheaper"


def test_undercut_default_and_strict(price, rivals, frame):
    shop = frame([("a", 100, "medium", False, True), ("b", 100, "high", True, True)], PRODUCT)
    df = price([("a", "amazon", 99, False, "1", 0, 0, NOW), ("b", "ebay", 95, True, "2", 0, 0, NOW), ("b", "amazon", 90, True, "3", 0, 0, NOW)])
    assert signals.undercut_signals(df, shop, rivals).count() == 3
    strict = signals.undercut_signals(df, shop, rivals, strict=True).collect()
    assert [(r["competitor_price"], r["priority"]) for r in strict] == [(D("90.00"), 1)]
    assert strict[0]["recommendation"] == "URGENT: Competitor undercutting by 10.0000000000000%"


def test_current_signals_equal_newest_of_all(price, rivals, frame):
    shop = frame([("a", 100, "low", True, True)], PRODUCT)
    df = price([("a", "amazon", p, s, str(i), i, i * 1000, NOW) for i, (p, s) in enumerate([(90, True), (120, True), (80, False), (130, True), (85, False)])])
    want = signals.newest_per_key(signals.all_signals(df, shop, rivals, NOW))
    got = signals.current_signals(df, shop, rivals, NOW)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert got.count() == 4


def test_movement_threshold_is_inclusive(price, rivals, frame):
    shop = frame([("a", 100, "low", True, True)], PRODUCT)
    df = price([("a", "amazon", p, True, str(i), i, i, NOW) for i, p in enumerate([100, 110, 110, 99, 90])])
    got = sorted((r["previous_price"], r["new_price"], r["direction"]) for r in signals.price_movements(df, shop, rivals).collect())
    assert got == [(D("100.00"), D("110.00"), "up"), (D("110.00"), D("99.00"), "down")]


def test_market_summary_ties_and_unknown_cheapest(price, rivals, frame):
    shop = frame([("a", 100, "low", True, True), ("b", 100, "low", True, True)], PRODUCT)
    df = price(
        [("a", "eBay", 90, False, "1", 0, 0, NOW), ("a", "Amazon", 90, True, "2", 0, 0, NOW), ("a", "Amazon", 95, True, "3", 0, -5, NOW),
         ("b", "Nobody", 10, True, "4", 0, 0, NOW), ("b", "Amazon", 90, True, "5", 0, 0, NOW)]
    )
    got = market.product_market_summary(df, shop, rivals, NOW).collect()
    assert [(r["product_sku"], r["cheapest_competitor_id"], r["gap_pct"], r["competitor_count"], r["in_stock_competitor_count"]) for r in got] == [
        ("a", 1, D("10.00"), 2, 1)
    ]


def test_changelog_order_and_delete(frame, spark):
    row = schemas.COMPETITOR
    make = lambda op, ts, before, after: json.dumps({"op": op, "op_ts": ts, "before": before, "after": after})
    one, two = {"id": 1, "name": "A", "code": "a"}, {"id": 1, "name": "B", "code": "a"}
    lines = [
        make("u", "2024-01-02T00:00:00Z", one, two), make("r", "2024-01-01T00:00:00Z", None, one),
        make("r", "2024-01-01T00:00:00Z", None, {"id": 2, "name": "C", "code": "c"}),
        make("d", "2024-01-01T00:00:00Z", {"id": 2, "name": "C", "code": "c"}, None), "{broken",
    ]
    parsed = spark.createDataFrame([(v,) for v in lines], "value string").select(F.from_json("value", schemas.change_event(row)).alias("d")).select("d.*").filter("op is not null")
    got = dims.apply_changelog(parsed, ["id"]).collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "B")]
    assert dims.competitors_dim(dims.apply_changelog(parsed, ["id"])).first()["code"] == "a"


def test_envelope_fallbacks(spark):
    quote = {"price": 9.5, "in_stock": True, "sku": "s", "data_timestamp": "2024-01-01T01:00:00+01:00"}
    docs = [
        {"product": {"sku": "a"}, "collection_timestamp": "2024-01-01T00:00:05+00:00",
         "data_sources": {"competitors": {"amazon": quote, "ebay": None}, "aggregators": {"x": {"available": True, "data_last_updated": "bad"}}}},
        {"product": {"sku": "b"}, "collection_timestamp": "2024-01-01T00:00:05+00:00",
         "data_sources": {"competitors": {"amazon": {**quote, "data_timestamp": "bad"}}}},
        {"product": {"sku": "c"}, "collection_timestamp": "2024-01-01T00:00:05+00:00", "data_sources": {"competitors": {"amazon": {"price": 1}}}},
        {"data_sources": {"competitors": {"amazon": quote}}},
    ]
    lines = [json.dumps(d) for d in docs] + ["{nope"]
    raw = spark.createDataFrame([(v,) for v in lines], "value string").withColumn("ingest_time", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    got = {r["product_sku"]: (r["api_collection_ts_ms"] - T, r["data_ts_ms"] - T) for r in ingest.flatten_competitor_prices(raw).collect()}
    assert got == {"a": (5000, 0), "b": (86400000, 86400000), "c": (5000, 5000)}
    agg = ingest.flatten_aggregator_prices(raw).collect()
    assert [(r["aggregator_name"], r["data_last_updated_ts_ms"] - T) for r in agg] == [("x", 5000)]


def test_behavior_ratios_guard_zero(spark):
    src = spark.createDataFrame([("a", 0, 1, None, 2, 1, 3, 1.5, T, T)], "sku string, page_views bigint, unique_visitors bigint, searches bigint, cart_additions bigint, purchases bigint, price_comparisons bigint, dwell_seconds double, data_ts_ms bigint, api_collection_ts_ms bigint")
    r = behavior.behavior_summary(src.withColumn("event_time", F.timestamp_millis("data_ts_ms"))).first()
    assert (r["search_rate"], r["search_cart_rate"], r["cart_purchase_rate"], r["view_compare_rate"]) == (0.0, 0.0, 0.5, 0.0)


def test_previous_window_gap_and_unknown_position(frame):
    summary = frame(
        [("a", "2024-01-01 00:00:00", "2024-01-01 00:05:00", 0.2), ("a", "2024-01-01 00:05:00", "2024-01-01 00:10:00", 0.5),
         ("a", "2024-01-01 00:15:00", "2024-01-01 00:20:00", 0.9)],
        "product_sku string;window_start timestamp;window_end timestamp;search_rate double",
    )
    signal = frame(
        [("a", "undercut", 4, "2024-01-01 00:06:00"), ("a", "UNDERCUT", -5, "2024-01-01 00:07:00")],
        "product_sku string;signal_type string;percentage_diff decimal(5,2);signal_timestamp timestamp",
    )
    got = [(round(r["engagement_delta"], 6), r["price_position"], round(r["score"], 6), r["avg_undercut_gap_pct"])
           for r in demand.demand_vs_signals(summary, signal).orderBy("window_start").collect()]
    assert got == [(0.0, "unknown", 0.0, D("0.00")), (0.3, "competitor_cheaper", 0.32, D("4.50")), (0.0, "unknown", 0.0, D("0.00"))]


def test_price_as_of_exact_change(frame):
    roll = frame([("a", NOW, 3), ("b", NOW, 4), ("c", NOW, 5)], "product_sku string;observed_at timestamp;demand bigint")
    shop = frame([("a", 10, None, True, True), ("b", 20, None, True, True), ("c", 30, None, True, False)], PRODUCT)
    hist = frame([("a", NOW, 7), ("a", "2024-01-03 00:00:00", 6), ("b", "2024-01-05 00:00:00", 9)], "sku string;change_timestamp timestamp;adjusted_price decimal(10,2)")
    got = {r["sku"]: r["price"] for r in elasticity.price_as_of(roll, shop, hist).collect()}
    assert got == {"a": D("7.00"), "b": D("20.00")}


def test_elasticity_needs_enough_varied_pairs(spark):
    def obs(sku, n, price, sold):
        return [(sku, i, float(price(i)), sold(i)) for i in range(n)]

    rows = (
        obs("n19", 19, lambda i: 10 + i, lambda i: 100 - i) + obs("n20", 20, lambda i: 10 + i, lambda i: 100 - i)
        + obs("flat", 30, lambda i: 10, lambda i: 100 - i) + obs("zero", 25, lambda i: 10 + i, lambda i: 0 if i < 6 else 50)
        + obs("many", 250, lambda i: 10 + i % 7 if i < 200 else 9999, lambda i: 70 - i % 7)
    )
    df = spark.createDataFrame(rows, "sku string, i bigint, price double, demand int").select(
        "sku", (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=F.col("i").cast("int"))).alias("observed_at"),
        F.col("price").cast("decimal(10,2)").alias("price"), "demand",
    )
    got = {r["sku"]: (r["price_elasticity"], r["observations"]) for r in elasticity.price_elasticity(df, NOW).collect()}
    assert set(got) == {"n20", "many"} and got["many"][1] == 250
    newest = Settings(elasticity_newest=200)
    kept = {r["sku"]: r["observations"] for r in elasticity.price_elasticity(df, NOW, newest).collect()}
    assert kept["many"] == 200
    xs, ys = [math.log(10 + i) for i in range(20)], [math.log(100 - i) for i in range(20)]
    mx, my = sum(xs) / 20, sum(ys) / 20
    slope = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / sum((a - mx) ** 2 for a in xs)
    assert got["n20"][0] == pytest.approx(slope)


def test_demand_baseline_is_the_recursive_average(frame):
    windows = [("a", "2024-01-03 23:30:00", "2024-01-03 23:35:00", 2), ("a", "2024-01-03 23:35:00", "2024-01-03 23:40:00", 6),
               ("a", "2024-01-03 23:45:00", "2024-01-03 23:45:00", 1), ("z", "2024-01-03 23:30:00", "2024-01-03 23:35:00", 0),
               ("one", "2024-01-03 23:30:00", "2024-01-03 23:35:00", 3)]
    df = frame(windows, "product_sku string;window_start timestamp;window_end timestamp;purchases bigint")
    a = 1 - math.exp(-math.log(2) / 60)
    level = 24.0
    for rate in (72.0, 12.0):
        level = level * (1 - a) + rate * a
    got = {r["sku"]: r["demand_baseline"] for r in proposals.demand_baseline(df, NOW).collect()}
    assert got["a"] == pytest.approx(level) and got["z"] == 1.0 and got["one"] == pytest.approx(36.0)


def test_moments_slide_to_the_same_slopes_as_a_fit_of_all_rows(spark):
    """A window moved ten times, cut inside hours, with a sku that leaves and one whose price never moves."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 3000, "gone").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("sku"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 26).cast("decimal(18,6)"))).alias("observed_at"),
        F.when(F.col("id") % 40 == 7, 50).otherwise(90 + F.col("id") * 17 % 23).cast("decimal(10,2)").alias("price"),
        (F.col("id") * 31 % 101).cast("int").alias("demand"),
    )
    rows = rows.cache()
    hourly = elasticity.hourly_moments(rows.filter("sku = 'hot'")).unionByName(elasticity.hourly_moments(rows.filter("sku <> 'hot'")))
    hourly = hourly.cache()
    between = lambda a, b: elasticity.moments_between(hourly, rows, str(a), str(b))
    end, length, step = dt.datetime(2024, 1, 4, 0, 20), dt.timedelta(hours=48), dt.timedelta(minutes=437)
    window = between(end - length, end)
    for _ in range(4):
        window = elasticity.slide_moments(window, between(end, end + step), between(end - length, end - length + step))
        end += step
    found = {r["sku"]: (r["price_elasticity"], r["observations"]) for r in elasticity.elasticity_of(window).collect()}
    seen = rows.filter(F.col("observed_at") < F.lit(str(end)).cast("timestamp"))
    whole = elasticity.price_elasticity(seen, str(end), Settings(elasticity_hours=48)).collect()
    assert set(found) == {r["sku"] for r in whole} and "gone" not in found and "hot" in found
    for r in whole:
        assert found[r["sku"]][1] == r["observations"]
        assert found[r["sku"]][0] == pytest.approx(r["price_elasticity"], abs=1e-8)


FEATURE = "sku string;price double;cost double;min_viable_price double;elasticity double"


def test_grid_floor_ties_and_default_elasticity(frame):
    df = frame([("floor", 100.0, 99.0, 120.0, -1.0), ("free", 100.0, 50.0, None, -1.0), ("elastic", 100.0, 50.0, None, -3.0)], FEATURE)
    got = {r["sku"]: r["proposed_price"] for r in proposals.grid_proposals(df).collect()}
    assert got == {"floor": 120.0, "free": 105.0, "elastic": 95.0}
    shop = frame([("a", 10, 5, None, 0, True, True), ("b", 10, 5, None, None, True, True), ("c", 10, 5, None, -2, True, False)],
                 "sku string;current_price decimal(10,2);cost decimal(10,2);min_viable_price decimal(10,2);price_elasticity decimal(6,3);in_stock boolean;is_active boolean")
    assert {r["sku"]: r["elasticity"] for r in proposals.pricing_features(shop).collect()} == {"a": -1.0, "b": -1.0}


def test_proposals_never_below_floor(frame):
    df = frame([(f"s{i}", 50.0 + i, 20.0 + 3 * i, 45.0 if i % 2 else None, -0.3 * i) for i in range(20)], FEATURE)
    cheap = frame([(f"s{i}", 1, 40.0 + i) for i in range(20)], "sku string;competitor_id bigint;prediction double")
    rows = proposals.grid_proposals(df).unionByName(proposals.forecast_proposals(df, cheap)).join(df, "sku").collect()
    for r in rows:
        assert r["proposed_price"] + 0.005 >= max(r["cost"] * 1.05, r["min_viable_price"] or 0)


OFFER = ("id bigint;sku string;old_price decimal(10,2);proposed_price decimal(10,2);status string;effective_from timestamp;"
         "expires_at timestamp;created_at timestamp;approved_at timestamp;reason_code string;notes string;applied_at timestamp;approved_by string")  # fmt: skip


def offer(i, sku, old, new, status="approved", start=None, end=None, created="2024-01-01 00:00:00", approved=None, notes=None):
    return (i, sku, old, new, status, start, end, created, approved, "r", notes, None, None)


def test_apply_chain_stale_and_windows(frame):
    offers = frame(
        [offer(1, "a", 10, 12, approved="2024-01-02 00:00:00"), offer(2, "a", 12, 15, approved="2024-01-02 00:00:01"),
         offer(3, "a", 10, 9, notes="x"), offer(4, "b", None, 7), offer(5, "b", 5, 6, end="2024-01-03 00:00:00"),
         offer(6, "b", 5, 6, start="2024-01-05 00:00:00"), offer(7, "b", 7, 8, status="pending", created="2024-01-02 00:00:00")],
        OFFER,
    )
    shop = frame([("a", 10, None), ("b", 5, None), ("c", 1, None)], "sku string;current_price decimal(10,2);updated_at timestamp")
    picked = proposals.apply_candidates(offers, NOW)
    assert sorted(r["id"] for r in picked.collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in proposals.apply_candidates(offers, NOW, limit=2).collect()) == [1, 2]
    out = proposals.apply_outputs(shop, offers, proposals.apply_proposals(shop, picked), NOW)
    assert {r["sku"]: r["current_price"] for r in out.products.collect()} == {"a": D("15.00"), "b": D("7.00"), "c": D("1.00")}
    marked = {r["id"]: (r["status"], r["notes"], r["applied_at"] is not None) for r in out.proposals.collect()}
    assert marked[3] == ("rejected", "x stale_or_mismatch", True) and marked[1] == ("applied", None, True)
    assert marked[5] == ("approved", None, False)
    assert tuple(out.counts.first()) == (3, 1) and out.history.count() == 3
    auto = proposals.apply_proposals(shop, proposals.apply_candidates(offers, NOW, auto_pending=True))
    assert {r["id"]: r["outcome"] for r in auto.collect()}[7] == "applied"


def test_moderation(frame):
    offers = frame([offer(1, "a", 1, 2, status="applied", notes="n"), offer(2, "a", 1, 2, status="pending"), offer(3, "a", 1, 2)], OFFER)
    votes = frame([(1, "rejected", "late"), (2, "approved", None)], "id bigint;status string;note string")
    got = {r["id"]: (r["status"], r["approved_by"], r["notes"], r["approved_at"] is not None) for r in proposals.moderate(offers, votes, NOW).collect()}
    assert got == {1: ("rejected", "dashboard", "n late", False), 2: ("approved", "dashboard", "", True), 3: ("approved", None, None, False)}


def test_run_guard(frame):
    hist = frame([(NOW,)] * 3, "collection_timestamp timestamp")
    decide = lambda rows: proposals.should_run(frame(rows, "finished_at timestamp"), hist, NOW).first()["run"]
    assert decide([(None,)]) is True
    assert decide([("2024-01-03 23:00:00",)]) is False
    assert decide([("2024-01-03 12:00:00",)]) is True


def test_forecast_lengths(frame, spark):
    rows = [(s, 1, f"2024-01-0{1 + i // 200} {i // 12 % 16:02d}:{i % 12 * 5:02d}:00", 100 + (i * 7) % 11) for s, n in (("w1", 1), ("w9", 9), ("w10", 10), ("w60", 60)) for i in range(n)]
    hist = frame(rows, "product_sku string;competitor_id bigint;collection_timestamp timestamp;price decimal(10,2)")
    got = {r["sku"]: r for r in forecast.forecast_competitor_prices(hist, NOW).collect()}
    assert [got[s]["n_samples"] for s in ("w1", "w9", "w10", "w60")] == [0, 7, 8, 58]
    assert got["w9"]["cv_mae"] is None and got["w9"]["prediction"] == got["w9"]["last_price"] and not got["w9"]["reliable"]
    assert got["w10"]["cv_r2"] is None and got["w10"]["cv_mae"] is not None  # one-row test folds have no R2
    assert got["w60"]["cv_r2"] is not None
    windows = forecast.history_windows(hist, NOW)
    naive = {r["sku"]: r["n_samples"] for r in forecast.naive_forecast(windows).collect()}
    assert naive == {"w1": 0, "w9": 7}
    base = {r["product_sku"]: r["baseline_mae"] for r in forecast.baseline_mae(forecast.forecast_features(windows)).collect()}
    assert base["w60"] == pytest.approx(got["w60"]["baseline_mae"], abs=1e-4) and base["w10"] == pytest.approx(got["w10"]["baseline_mae"], abs=1e-4)


def test_reliability_needs_nonzero_errors(frame):
    df = frame([("a", 0.0, 0.5), ("b", 0.3, 0.5), ("c", 0.3, 0.0), ("d", 0.6, 5.0), ("e", None, 1.0), ("f", 0.5, 0.4)], "sku string;cv_mae double;baseline_mae double")
    got = {r["sku"]: (r["confidence"], r["reliable"]) for r in forecast.score_reliability(df).collect()}
    assert got["a"] == (None, False) and got["c"] == (None, False) and got["e"] == (None, False)
    assert got["b"] == (pytest.approx(0.4), True) and got["d"][1] is False and got["f"] == (0.0, False)


def test_pivots_and_empty_selection(frame):
    trends = frame(
        [("a", "x", "2024-01-01 00:00:00", "2024-01-01 00:05:00", 10, 1, "up"), ("b", "x", "2024-01-01 01:00:00", "2024-01-01 01:05:00", 20, 3, "down")],
        "product_sku string;competitor_code string;window_start timestamp;window_end timestamp;avg_price decimal(10,2);price_volatility decimal(5,2);trend_direction string",
    )
    assert price_trends.volatility_pivot(trends, ["a", "b"]).first().asDict() == {"competitor_code": "x", "a": 1.0, "b": 3.0}
    next_day = trends.withColumn("window_end", F.col("window_end") + F.expr("interval 1 day")).withColumn("avg_price", F.col("avg_price") * 3)
    hours = ["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-02 00:00"]
    pivot = price_trends.hourly_price_pivot(trends.unionByName(next_day.select(trends.columns)), hours)
    wide = {r["product_competitor"]: tuple(r[h] for h in hours) for r in pivot.collect()}
    assert wide == {"a | x": (10.0, None, 30.0), "b | x": (None, 20.0, None)}
    moves = trends.select("product_sku", "competitor_code")
    assert price_trends.movements_or_all(moves, skus=["a"]).count() == 1
    assert price_trends.movements_or_all(moves, skus=["q"]).count() == 2


def test_sequential_changes_are_excluded_and_unknown_types_pass(frame):
    df = frame([("a", 1, "x", "SEQUENTIAL_CHANGE", 1, NOW), ("a", 1, "x", "ODD", 2, NOW)], "product_sku string;competitor_id bigint;competitor_name string;signal_type_norm string;percentage_diff decimal(5,2);signal_timestamp timestamp")
    assert overview.actionable(df).count() == 1
    assert price_signals.actionable(df).first()["signal_type_norm"] == "ODD"


def test_platform_series_seed_and_fill(frame):
    shop = frame([("a", 10, None, True, True)], PRODUCT)
    hist = frame([("a", 12, "2024-01-03 12:07:00", 1), ("a", 13, "2024-01-03 12:09:00", 2), ("a", 9, "2024-01-01 00:00:00", 3)], "sku string;adjusted_price decimal(10,2);change_timestamp timestamp;proposal_id bigint")
    got = {str(r["ts"]): r["adjusted_price"] for r in adjustments.platform_price_series(hist, shop, NOW, days=1).collect()}
    assert len(got) == 97 and got["2024-01-03 12:00:00"] == D("10.00") and got["2024-01-03 12:15:00"] == D("13.00") and got[NOW] == D("13.00")


def test_proposal_steps_close_at_given_end(frame):
    offers = frame([offer(1, "a", 1, 2, status="pending", created="2024-01-02 00:00:00"), offer(2, "a", 1, 3, created="2024-01-03 00:00:00"), offer(3, "b", 1, 4, status="pending", created="2024-01-02 00:00:00")], OFFER)
    ends = frame([("a", "2024-01-06 00:00:00")], "sku string;domain_end timestamp")
    got = sorted((r["sku"], str(r["ts"]), r["price"], r["closing"]) for r in adjustments.proposal_steps(offers, NOW, ends=ends).collect())
    assert got == [("a", "2024-01-03 00:00:00", D("3.00"), False), ("a", "2024-01-06 00:00:00", D("3.00"), True),
                   ("b", "2024-01-02 00:00:00", D("4.00"), False), ("b", NOW, D("4.00"), True)]
