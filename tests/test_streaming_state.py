"""State processors on plain state, and the position a stream starts from."""

import os
import time
from datetime import datetime, timezone
from types import SimpleNamespace

import pandas as pd
import pytest

from shelfwise.sources import streams
from shelfwise.streaming import jobs
from shelfwise.streaming.ordered import ROW, PricedPairs
from shelfwise.streaming.updating import LATEST, PRODUCT, HistoryBesideTrends, LatestPerCompetitor, NewestChange, RepricedPairs
from tests.test_streaming import quote, write_lines

SECOND = 1_000_000


class State(dict):
    """A map state, or a value state under one key, that counts what it hands over."""

    def __init__(self):
        self.read = 0

    def exists(self):
        return bool(self)

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.read += 1
        return dict.get(self, key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))

    def get(self):
        return dict.get(self, ())

    def update(self, value):
        self[()] = value


class Handle:
    def __init__(self):
        self.timers = set()
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


def started(processor):
    processor.init(handle := Handle())
    return processor, handle


def fire(processor, handle, key, watermark_ms):
    """All rows that timers up to the watermark give, in the order Spark calls them."""
    out = []
    for at in sorted(t for t in handle.timers if t <= watermark_ms):
        handle.timers.discard(at)
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
        out += list(processor.handleExpiredTimer(key, times, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
    return pd.concat(out) if out else pd.DataFrame()


def ticks(n):
    return pd.DataFrame([(i * 700_000, i, str(i), 1000 + (i * 7919) % 500, True) for i in range(n)], columns=ROW)


def test_many_waiting_rows_of_one_pair():
    """100,000 waiting rows are read once each, and take time in proportion."""
    spent = {}
    for n in (10_000, 100_000):
        processor, handle = started(PricedPairs())
        rows = ticks(n).sample(frac=1, random_state=1)
        begun = time.perf_counter()
        for a in range(0, n, 5000):
            list(processor.handleInputRows(("a", "x"), iter([rows[a : a + 5000]]), None))
        out = fire(processor, handle, ("a", "x"), n * 700 + 60_000)
        spent[n] = time.perf_counter() - begun
        assert len(out) == n and out["at"].is_monotonic_increasing
        assert out["previous"].tolist()[1:] == out["cents"].tolist()[:-1]
        assert handle.states["pending"].read <= 20 * (n * 0.7 / 60 + 2) and not handle.states["pending"] and not handle.states["parts"]
        assert len(handle.timers) == 0
    assert spent[100_000] < 30 * spent[10_000]


def test_a_minute_that_the_watermark_cuts():
    processor, handle = started(PricedPairs())
    list(processor.handleInputRows(("a", "x"), iter([ticks(80)]), None))
    first = fire(processor, handle, ("a", "x"), 20_000)
    assert first["at"].max() < 20_000_000 <= first["at"].max() + 700_000
    list(processor.handleInputRows(("a", "x"), iter([ticks(90)[80:]]), None))
    rest = fire(processor, handle, ("a", "x"), 10**9)
    assert sorted(first["at"].tolist() + rest["at"].tolist()) == ticks(90)["at"].tolist()
    assert rest["previous"].iloc[0] == first["cents"].iloc[-1]


def price(at, cents, name, stock=True):
    return (name, at * SECOND, at, str(at), cents, stock)


def test_a_dearer_update_takes_back_the_cheapest():
    processor, _ = started(LatestPerCompetitor())
    give = lambda *rows: list(processor.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["competitor_name", *LATEST])]), None))[0].iloc[0]
    row = give(price(1, 900, "X"), price(1, 950, "Y", False))
    assert (row["code"], row["cents"], row["n"], row["stocked"]) == ("x", 900, 2, 1)
    row = give(price(2, 990, "X"))
    assert (row["code"], row["cents"], row["version"]) == ("y", 950, 2)
    row = give(price(1, 100, "X"))  # older than what is known
    assert (row["code"], row["cents"]) == ("y", 950)


def test_a_product_change_gives_all_its_pairs():
    processor, _ = started(RepricedPairs())
    columns = ["competitor_name", *LATEST, "op_at", "rank", *PRODUCT]

    def give(*rows):
        frame = pd.DataFrame([r + (None,) * (len(columns) - len(r)) for r in rows], columns=columns)
        out = list(processor.handleInputRows(("a",), iter([frame]), None))
        return {r.competitor_name: r for r in out[0].itertuples()} if out else {}

    product = lambda at, rank, ours: (None,) * 6 + (at, rank, ours, "high", True, True)
    assert give(price(1, 900, "X"), price(1, 950, "Y")) == {}
    assert {k: r.ours for k, r in give(product(10, 1, 920)).items()} == {"X": 920, "Y": 920}
    assert {k: (r.cents, r.ours) for k, r in give(price(5, 940, "X")).items()} == {"X": (940, 920)}
    assert give(product(9, 1, 100)) == {}  # committed earlier
    assert {k: r.ours for k, r in give(product(11, 1, 999)).items()} == {"X": 999, "Y": 999}
    assert all(r.ours is pd.NA for r in give(product(12, 2, None)).values())
    assert give(product(11, 1, 5)) == {}  # a delete is remembered


def test_changes_out_of_order():
    processor, _ = started(NewestChange())
    give = lambda *rows: [tuple(r[2:]) for f in processor.handleInputRows(("t", "k"), iter([pd.DataFrame(rows, columns=["at", "rank", "after"])]), None) for r in f.itertuples(index=False)]
    assert give((5, 0, "a"), (4, 1, "old")) == [(5, 0, "a")]
    assert give((3, 2, None)) == [] and give((6, 2, None)) == [(6, 2, None)] and give((6, 1, "b")) == []


def test_history_beside_trends_in_one_state():
    processor, handle = started(HistoryBesideTrends())
    columns = ["at", "data_ms", "kafka_at", "source_sku", "cents", "in_stock", "api_ms"]
    row = lambda s, cents, broker, data=True: (s * SECOND, float(s * 1000) if data else None, broker, "s", cents, True, s)
    list(processor.handleInputRows(("a", "x"), iter([pd.DataFrame([row(1, 100, 5), row(1, 300, 9), row(2, 200, 5, False)], columns=columns)]), None))
    list(processor.handleInputRows(("a", "x"), iter([pd.DataFrame([row(1, 150, 7), row(400, 500, 7)], columns=columns)]), None))
    out = fire(processor, handle, ("a", "x"), 300_000)
    trend, record = out[~out["is_history"]].iloc[0], out[out["is_history"]]
    assert (trend["n"], trend["total"], trend["opened"], trend["closed"]) == (4, 750, 300, 200)
    assert record[["data_ms", "cents"]].values.tolist() == [[1000, 300]] and handle.timers == {600_000}


def test_start_is_fixed_with_the_checkpoint(spark, folder):
    now = datetime.now(timezone.utc).timestamp()
    path = write_lines(folder, "in", [[quote("old", "x", 100, 0)]])
    checkpoint = f"{folder}/cp"
    seen = []
    read = lambda: streams.read_competitor_prices(spark, path, starting="latest", checkpoint=checkpoint)
    keep = lambda df, _: seen.extend(r["product_sku"] for r in df.collect())
    jobs.start(read(), keep, checkpoint, trigger=None).awaitTermination()
    first = streams.fixed_start(spark, checkpoint)
    for name in ("new", "newer"):
        with open(f"{path}/{name}.json", "w") as f:
            import json

            f.write(json.dumps(quote(name, "x", 100, 0)) + "\n")
        os.utime(f"{path}/{name}.json", (now + 3600,) * 2)
        jobs.start(read(), keep, checkpoint, trigger=None).awaitTermination()
    assert seen == ["new", "newer"] and streams.fixed_start(spark, checkpoint) == first
    with pytest.raises(ValueError):
        streams.read_competitor_prices(spark, path, starting="latest")


def test_kafka_options():
    plain = streams.kafka_options("h:1", "t", "latest", failOnDataLoss="false")
    assert plain["startingOffsets"] == "latest" and plain["failOnDataLoss"] == "false" and plain["subscribe"] == "t"
    timed = streams.kafka_options("h:1", "t", started_at="2024-01-01 00:00:00")
    assert timed["startingTimestamp"] == "1704067200000" and "startingOffsets" not in timed
