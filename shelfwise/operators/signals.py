"""Price signals and price movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import DEFAULTS, Settings
from shelfwise.functions.columns import ago, by_sensitivity, pct_of, signal_priority
from shelfwise.functions.ordered import HOUR, ordered_lag, ordered_range_min

PAIR = ["product_sku", "competitor_name"]
TIES = ["api_collection_ts_ms", "source_sku", "price"]

# Recommendation texts by sensitivity (high, medium, other); {} is the percentage.
UNDERCUT_TEXT = (
    "URGENT: Competitor undercutting by {}%",
    "Consider price adjustment: {}% undercut",
    "Monitor: {}% undercut",
)
OVERPRICED_TEXT = (
    "Opportunity: We are {}% cheaper",
    "Good position: {}% cheaper",
    "Competitive: {}% cheaper",
)
STOCKOUT_TEXT = (
    "URGENT: Competitor out of stock - opportunity to capture market",
    "Competitor out of stock - consider inventory management",
    "Competitor out of stock",
)
INCREASE_TEXT = (
    "Opportunity: Competitor raised price {}% from 24h low",
    "Consider adjustment: Competitor up {}% from 24h low",
    "Monitor: Competitor up {}% from 24h low",
)

Case = tuple[Column, Column]


def with_dimensions(prices: DataFrame, products: DataFrame, competitors: DataFrame) -> DataFrame:
    """Price records of known products and competitors, with the fields the rules read.

    No broadcast hint: the planner broadcasts a dimension only when its measured size is
    under the threshold, and falls back to a skew-aware sort-merge join beyond it.
    """
    ours = products.select(
        F.col("sku").alias("product_sku"),
        F.col("current_price").alias("platform_price"),
        "price_sensitivity",
        F.col("in_stock").alias("we_stock"),
        "is_active",
    )
    theirs = competitors.select("code", F.col("id").alias("competitor_id"))
    return (
        prices.join(ours, "product_sku")
        .join(theirs, F.lower("competitor_name") == F.col("code"))
        .drop("code")
    )


def of_known_competitors(prices: DataFrame, competitors: DataFrame) -> DataFrame:
    """Rows whose competitor has a dimension row. It holds for whole pairs, so it may run before an ordered computation."""
    return prices.join(competitors.select("code"), F.lower("competitor_name") == F.col("code"), "left_semi")


def sellable() -> Column:
    return F.col("we_stock") & F.col("is_active")


def _text(template: tuple[str, str, str], pct: Column | None = None) -> Column:
    def render(part: str) -> Column:
        if pct is None:
            return F.lit(part)
        head, tail = part.split("{}")
        return F.concat(F.lit(head), pct.cast("string"), F.lit(tail))

    return by_sensitivity(F.col("price_sensitivity"), *(render(p) for p in template))


def _row(kind: str, pct: Column | None, text: Column, priorities: tuple[int, int, int]) -> Column:
    diff = F.lit(0).cast("decimal(5,2)") if pct is None else pct.try_cast("decimal(5,2)")
    return F.struct(
        F.lit(kind).alias("signal_type"),
        F.col("platform_price"),
        F.col("price").alias("competitor_price"),
        diff.alias("percentage_diff"),
        text.alias("recommendation"),
        signal_priority(F.col("price_sensitivity"), *priorities).alias("priority"),
    )


def undercut_case(strict: bool, threshold: float) -> Case:
    pct = pct_of(F.col("platform_price") - F.col("price"), F.col("platform_price"))
    cond = F.col("price") < F.col("platform_price")
    if strict:
        cond = cond & (pct > threshold) & F.col("in_stock") & sellable()
    return cond, _row("UNDERCUT", pct, _text(UNDERCUT_TEXT, pct), (1, 2, 3))


def overpriced_case(threshold: float) -> Case:
    pct = pct_of(F.col("price") - F.col("platform_price"), F.col("platform_price"))
    cond = (F.col("price") > F.col("platform_price")) & (pct > threshold) & F.col("in_stock") & sellable()
    return cond, _row("OVERPRICED", pct, _text(OVERPRICED_TEXT, pct), (2, 3, 3))


def stockout_case() -> Case:
    cond = ~F.col("in_stock") & sellable()
    return cond, _row("STOCKOUT", None, _text(STOCKOUT_TEXT), (1, 2, 3))


def increase_case(threshold: float, as_of, settle_minutes: int) -> Case:
    low = F.col("low_24h")
    pct = pct_of(F.col("price") - low, low)
    cond = (
        (F.col("price") > low)
        & (pct > threshold)
        & F.col("in_stock")
        & sellable()
        & (F.col("event_time") < ago(as_of, minutes=settle_minutes))
    )
    return cond, _row("PRICE_INCREASE_24H", pct, _text(INCREASE_TEXT, pct), (2, 3, 3))


def _output() -> list:
    return [
        "product_sku",
        "competitor_id",
        "_s.*",
        "in_stock",
        F.col("event_time").alias("signal_timestamp"),
        F.lit(True).alias("is_active"),
    ]


def emit(joined: DataFrame, *cases: Case) -> DataFrame:
    """Rows of every case that holds. Several cases share one pass through an exploded array."""
    if len(cases) == 1:
        cond, row = cases[0]
        hits = joined.filter(cond).withColumn("_s", row)
    else:
        rows = F.array_compact(F.array(*[F.when(cond, row) for cond, row in cases]))
        hits = joined.withColumn("_s", F.explode(rows))
    return hits.select(*_output())


def undercut_signals(prices, products, competitors, strict: bool = False, threshold: float = DEFAULTS.undercut_pct):
    return emit(with_dimensions(prices, products, competitors), undercut_case(strict, threshold))


def overpriced_signals(prices, products, competitors, threshold: float = DEFAULTS.overpriced_pct):
    return emit(with_dimensions(prices, products, competitors), overpriced_case(threshold))


def stockout_signals(prices, products, competitors):
    return emit(with_dimensions(prices, products, competitors), stockout_case())


def with_low_24h(joined: DataFrame) -> DataFrame:
    """Lowest price of the pair over the preceding 24 hours, both ends included.

    In buckets of a day: most pairs have few rows an hour, and a window costs per bucket more than per row. A hot
    pair's day is one sort, which spills; no row waits in memory for it.
    """
    return ordered_range_min(joined, PAIR, "event_time", "price", "low_24h", bucket_seconds=24 * HOUR)


def price_increase_signals(
    prices, products, competitors, as_of, threshold: float = DEFAULTS.increase_24h_pct,
    settle_minutes: int = DEFAULTS.settle_minutes,
):
    # the dimension filters hold for whole pairs, so they may run before the ordered computation
    joined = with_dimensions(prices, products, competitors).filter(sellable())
    return emit(with_low_24h(joined), increase_case(threshold, as_of, settle_minutes))


def price_movements(prices, products, competitors, threshold: float = DEFAULTS.movement_pct):
    """Consecutive price changes of a pair of at least ``threshold`` percent."""
    joined = with_dimensions(prices, products, competitors).filter(sellable())
    return movement_rows(ordered_lag(joined, PAIR, "event_time", TIES, "price", "previous_price"), threshold)


def movement_rows(lagged: DataFrame, threshold: float = DEFAULTS.movement_pct) -> DataFrame:
    now, before = F.col("price"), F.col("previous_price")
    pct = pct_of(now - before, before)
    direction = F.when(now > before, "up").when(now < before, "down").otherwise("no change")
    return lagged.filter(before.isNotNull() & (F.abs(pct) >= threshold) & F.col("in_stock")).select(
        "product_sku",
        "competitor_id",
        "previous_price",
        now.alias("new_price"),
        pct.try_cast("decimal(6,2)").alias("pct_change"),
        direction.alias("direction"),
        "in_stock",
        "event_time",
    )


SIGNAL_KEY = ["product_sku", "competitor_id", "signal_type"]


def newest_per_key(signals: DataFrame) -> DataFrame:
    """One row per (sku, competitor, type): the newest qualifying event."""
    rest = [c for c in signals.columns if c not in SIGNAL_KEY]
    order = F.struct("signal_timestamp", "competitor_price", "in_stock")
    return (
        signals.groupBy(*SIGNAL_KEY)
        .agg(F.max_by(F.struct(*rest), order).alias("_s"))
        .select(*SIGNAL_KEY, "_s.*")
        .select(*signals.columns)
    )


def row_cases(settings: Settings = DEFAULTS) -> dict[str, Case]:
    """The rules that need no other row of the pair."""
    return {
        "UNDERCUT": undercut_case(False, settings.undercut_pct),
        "OVERPRICED": overpriced_case(settings.overpriced_pct),
        "STOCKOUT": stockout_case(),
    }


def cases(as_of, settings: Settings = DEFAULTS) -> dict[str, Case]:
    """All four rules; the last reads ``low_24h``."""
    return row_cases(settings) | {"PRICE_INCREASE_24H": increase_case(settings.increase_24h_pct, as_of, settings.settle_minutes)}


def all_signals(prices, products, competitors, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Every signal event of the four rules, from one scan and one pass over the joined rows."""
    joined = with_dimensions(with_low_24h(of_known_competitors(prices, competitors)), products, competitors)
    return emit(joined, *cases(as_of, settings).values())


def current_signals(prices, products, competitors, as_of, settings: Settings = DEFAULTS) -> DataFrame:
    """Newest qualifying event per (sku, competitor, type).

    Equal to ``newest_per_key(all_signals(...))``, but the four rules fold into four maxima of
    one aggregation that combines map-side, and texts are only written for the survivors.
    """
    return newest_of(with_dimensions(with_low_24h(of_known_competitors(prices, competitors)), products, competitors), cases(as_of, settings))


def newest_of(joined: DataFrame, rules: dict[str, Case]) -> DataFrame:
    """``newest_per_key(emit(joined, *rules.values()))`` by one maximum a rule, for rules that read the price, the stock and ``low_24h``."""
    hit = F.struct("event_time", "price", "in_stock", "low_24h")
    # the number leads the group because rows are sorted by it, and skus begin alike
    per_pair = (
        joined.groupBy(
            F.xxhash64("product_sku", "competitor_id").alias("_hash"),
            "product_sku", "competitor_id", "platform_price", "price_sensitivity",
        )
        .agg(*[F.max(F.when(cond, hit)).alias(kind) for kind, (cond, _) in rules.items()])
    )
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("hit")) for kind in rules])
    events = (
        per_pair.withColumn("_f", F.explode(found))
        .filter(F.col("_f.hit").isNotNull())
        .select("product_sku", "competitor_id", "platform_price", "price_sensitivity", "_f.kind", "_f.hit.*")
    )
    row = F.coalesce(*[F.when(F.col("kind") == kind, made) for kind, (_, made) in rules.items()])
    return events.withColumn("_s", row).select(*_output())
