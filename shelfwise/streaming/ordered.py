"""Event-time ordered state per (sku, competitor): previous price and 24-hour minimum.

Pairs are dealt into buckets. Rows wait in map state, the rows of a batch as one chunk, until the
watermark has passed them, then leave in time order. The same ties break as in the batch operators, so both give the same rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["product_sku", "competitor_name"]
ROW = ["at", "api_ms", "source_sku", "cents", "in_stock"]
ROW_DDL = "at bigint, api_ms bigint, source_sku string, cents bigint, in_stock boolean"
CHUNK_DDL = "at array<bigint>, api_ms array<bigint>, source_sku array<string>, cents array<bigint>, in_stock array<boolean>"
OUT_DDL = f"product_sku string, competitor_name string, {ROW_DDL}, previous bigint, low bigint"
MINUTE = 60_000_000
DAY = 24 * 3600 * 1_000_000


class PricedPairs(StatefulProcessor):
    """Every closed price of a pair with the price before it and the lowest price of the 24 hours up to it.

    A call into the state costs far more than a row in it, so the rows of a batch are put by as one chunk with one
    timer, at the least of them. ``pending`` holds chunks by (minute of the chunk's first row, number), ``parts`` the
    number of chunks of each minute. When a timer of a pair is due, all chunks that begin under the watermark are
    read at once and its other due timers find them gone. What is left of them, which lies within the watermark's delay
    unless a batch runs ahead, waits on by the minute: a row is written twice and read twice, however many wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "minute bigint, part bigint", CHUNK_DDL)
        self.parts = handle.getMapState("parts", "minute bigint", "n bigint, first bigint")
        self.memory = handle.getValueState("memory", "previous bigint, at array<bigint>, cents array<bigint>")
        self.done: dict[Any, int] = {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: list[tuple] = []
        for batch in rows:
            fresh += zip(*(map(_plain, batch[c].tolist()) for c in ROW))
        if fresh:
            self._keep(min(r[0] for r in fresh) // MINUTE, fresh)
        return iter(())

    def _keep(self, minute: int, rows: list[tuple]) -> None:
        """Put rows by, with a timer unless an earlier row of the minute has one."""
        n, first = self.parts.getValue((minute,)) or (0, None)
        self.pending.updateValue((minute, n), tuple(list(c) for c in zip(*rows)))
        least = min(r[0] for r in rows)
        if first is None or least < first:
            self.handle.registerTimer(least // 1000 + 1)
            first = least
        self.parts.updateValue((minute,), (n + 1, first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key) == limit:
            return
        self.done[key] = limit
        due = sorted((int(k[0]), int(v[0])) for k, v in self.parts.iterator() if int(v[1]) < limit)
        if not due:
            return
        rows: list[tuple] = []
        for minute, n in due:
            for part in range(n):
                rows += zip(*self.pending.getValue((minute, part)))
                self.pending.removeKey((minute, part))
            self.parts.removeKey((minute,))
        ready = sorted((r for r in rows if r[0] < limit), key=_order)
        later: dict[int, list[tuple]] = {}
        for r in rows:
            if r[0] >= limit:
                later.setdefault(r[0] // MINUTE, []).append(r)
        for minute, rest in later.items():
            self._keep(minute, rest)
        previous, at, cents = self.memory.get() or (None, [], [])
        window = deque(zip(at, cents))
        lows = _day_lows(ready, window)
        self.memory.update((ready[-1][3], [w[0] for w in window], [w[1] for w in window]))
        out = dict(zip(ROW, zip(*ready)))
        before = pd.array([previous, *out["cents"][:-1]], dtype="Int64")
        yield pd.DataFrame({KEY[0]: key[0], KEY[1]: key[1], **out, "previous": before, "low": pd.array(lows, dtype="Int64")})

    def close(self) -> None:
        pass


# Buckets that pairs are dealt into, and slots of a bucket; both are fixed with a job's checkpoint.
BUCKETS, SLOTS = 4096, 4
CHUNK_ROWS = 100_000
_KINDS = {
    "slot": pa.int64(), "product_sku": pa.string(), "competitor_name": pa.string(), "at": pa.int64(),
    "api_ms": pa.int64(), "source_sku": pa.string(), "cents": pa.int64(), "in_stock": pa.bool_(),
}
WAITING = pa.schema(list(_KINDS.items()))
KNOWN = pa.schema([(c, _KINDS[c]) for c in ("slot", *KEY, "at", "cents")])


class PricedBuckets(StatefulProcessor):
    """What ``PricedPairs`` gives for one pair, for a bucket of pairs at once: rows stand in columns.

    A call into the state costs as much as thousands of rows in it, so all that a batch brings for a bucket waits in
    chunks of at most ``CHUNK_ROWS`` rows, and all pairs of a bucket whose rows the watermark has passed are answered
    together. ``pending`` and ``parts`` are those of ``PricedPairs``. ``memory`` holds, by slot so that a batch of few
    rows reads few pairs, the rows that later ones may need: the candidates for the lowest price of the last 24 hours,
    and the last row of each pair, in order. Rows that are left wait on in pieces that begin one, two, four, ... minutes
    after the watermark: a row is written again as often as its distance to the watermark halves.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "minute bigint, part bigint", "rows binary")
        self.parts = handle.getMapState("parts", "minute bigint", "n bigint, first bigint")
        self.memory = handle.getMapState("memory", "slot bigint", "rows binary")
        self.done: dict[Any, int] = {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: list[pa.Table] = []
        for batch in rows:
            columns = [pa.array(batch[c], kind, from_pandas=True) for c, kind in _KINDS.items()]
            fresh.append(pa.Table.from_arrays(columns, schema=WAITING))
            if sum(map(len, fresh)) >= CHUNK_ROWS:
                self._keep(pa.concat_tables(fresh))
                fresh = []
        if fresh:
            self._keep(pa.concat_tables(fresh))
        return iter(())

    def _keep(self, rows: pa.Table) -> None:
        """Put rows by, with a timer unless an earlier row of the minute has one."""
        least = pc.min(rows["at"]).as_py()
        minute = least // MINUTE
        n, first = self.parts.getValue((minute,)) or (0, None)
        for part, at in enumerate(range(0, len(rows), CHUNK_ROWS), n):
            self.pending.updateValue((minute, part), (_packed(rows.slice(at, CHUNK_ROWS)),))
        if first is None or least < first:
            self.handle.registerTimer(least // 1000 + 1)
            first = least
        self.parts.updateValue((minute,), (part + 1, first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key) == limit:
            return
        self.done[key] = limit
        due = sorted((int(k[0]), int(v[0])) for k, v in self.parts.iterator() if int(v[1]) < limit)
        if not due:
            return
        chunks = []
        for minute, n in due:
            for part in range(n):
                chunks.append(_unpacked(self.pending.getValue((minute, part))[0]))
                self.pending.removeKey((minute, part))
            self.parts.removeKey((minute,))
        rows = pa.concat_tables(chunks)
        ahead = (rows["at"].to_numpy() - limit) // MINUTE
        for piece in np.unique(_bits(ahead[ahead >= 0])):
            self._keep(rows.filter(pa.array((ahead >= 0) & (_bits(ahead) == piece))))
        ready = rows.filter(pa.array(ahead < 0))
        slots = np.unique(ready["slot"].to_numpy())
        held = [self.memory.getValue((int(s),)) for s in slots]
        known = pa.concat_tables([KNOWN.empty_table(), *[_unpacked(h[0]) for h in held if h]])
        out, known = _answered(known, ready, limit)
        for s in slots:
            self.memory.updateValue((int(s),), (_packed(known.filter(pc.field("slot") == int(s))),))
        for first in range(0, len(out), CHUNK_ROWS):
            yield out.slice(first, CHUNK_ROWS).to_pandas(types_mapper=pd.ArrowDtype)

    def close(self) -> None:
        pass


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(bytes(data))) as rows:
        return rows.read_all()


def _bits(numbers: np.ndarray) -> np.ndarray:
    """Number of binary digits; those below zero count as zero."""
    return np.frexp(np.maximum(numbers, 0))[1]


def _pairs(rows: pa.Table) -> np.ndarray:
    """A number for each row's pair; nulls are a name of their own."""
    code = np.zeros(len(rows), np.int64)
    for name in KEY:
        names = rows[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * len(names.dictionary) + names.indices.to_numpy()
    return np.unique(code, return_inverse=True)[1]


def _answered(known: pa.Table, ready: pa.Table, limit: int) -> tuple[pa.Table, pa.Table]:
    """``ready`` in order with ``previous`` and ``low``, and the rows of ``known`` and ``ready`` that rows from ``limit`` on may need.

    Rows of ``known`` are earlier than those of ``ready``, and those of a pair stand in order.
    """
    n = len(known)
    pair = _pairs(pa.concat_tables([known.select(KEY), ready.select(KEY)]))
    ties = {"pair": pa.array(pair[n:]), **{c: ready[c] for c in ROW}, "in_stock": ready["in_stock"].cast(pa.int8())}
    order = pc.sort_indices(pa.table(ties), sort_keys=[(c, "ascending") for c in ties], null_placement="at_start")
    ready, pair = ready.take(order), np.concatenate([pair[:n], pair[n:][order.to_numpy()]])
    both = pa.concat_tables([known, ready.select(KNOWN.names)]).combine_chunks()
    place = np.argsort(pair, kind="stable")
    both, pair, new = both.take(pa.array(place)), pair[place], place >= n
    at = both["at"].to_numpy()
    last = np.append(pair[1:] != pair[:-1], True)
    first = np.append(True, last[:-1])
    cents = both["cents"].combine_chunks()
    missing = cents.is_null().to_numpy(zero_copy_only=False)
    value = cents.fill_null(0).to_numpy().copy()
    low = value.min()
    none = value.max() - low + 1
    value = np.where(missing, none, value - low)  # from 0 to none
    lows = _range_least(value, *_day_before(pair, at))
    nothing = lambda found, where: pa.array(found[new], mask=where[new])
    out = ready.select([*KEY, *ROW]).append_column("previous", nothing(np.append(0, value[:-1]) + low, first | np.append(True, missing[:-1])))
    out = out.append_column("low", nothing(lows + low, lows == none))
    # a row stays a candidate while no later one of its pair is as cheap; pairs stand apart by more than any price
    apart = value + pair * (none + 1)
    later = np.append(np.minimum.accumulate(apart[::-1])[::-1][1:], np.iinfo(np.int64).max)
    return out, both.filter(pa.array(last | ((at >= limit - DAY) & (apart < later))))


def _day_before(pair: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the rows of its pair in the 24 hours up to each row, peers included; rows stand by pair and time."""
    n = len(at)
    asks = np.repeat([0, 1], n)
    order = np.lexsort((asks, np.concatenate([at - DAY, at]), np.concatenate([pair, pair])))
    rows = asks[order] == 1
    first = np.empty(n, np.int64)
    first[order[~rows]] = np.cumsum(rows)[~rows]
    ends = np.flatnonzero(np.append((pair[1:] != pair[:-1]) | (at[1:] != at[:-1]), True))
    return first, ends[np.searchsorted(ends, np.arange(n))]


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair of places, from minima over 1, 2, 4, ... values."""
    out = np.empty(len(first), values.dtype)
    level = _bits(last - first + 1) - 1
    for k in range(int(level.max(initial=-1)) + 1):
        pick = level == k
        out[pick] = np.minimum(values[first[pick]], values[last[pick] - (1 << k) + 1])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def _plain(value: Any) -> Any:
    """A state value: a Python scalar, missing ones as None."""
    value = value.item() if hasattr(value, "item") else value
    return None if value != value else value


def _order(row: tuple) -> tuple:
    """Time, then the ties of the batch operators, nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


def _day_lows(ready: list[tuple], window: deque) -> list[int]:
    """Minimum over the last 24 hours of each row, peers included; ``window`` is the increasing run of candidates."""
    lows: list[int] = []
    i = 0
    while i < len(ready):
        at, end = ready[i][0], i
        while end < len(ready) and ready[end][0] == at:
            end += 1
        low = min(r[3] for r in ready[i:end])
        while window and window[-1][1] >= low:
            window.pop()
        window.append((at, low))
        while window[0][0] < at - DAY:
            window.popleft()
        lows.extend([window[0][1]] * (end - i))
        i = end
    return lows


def stream_priced_pairs(stream: DataFrame) -> DataFrame:
    """Watermarked prices with ``previous_price`` and ``low_24h`` of the pair, each row once the watermark has passed it.

    A row without a time is left out: no watermark passes it.
    """
    spread = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS * SLOTS))
    rows = stream.filter(F.col("event_time").isNotNull()).select(
        (spread % BUCKETS).alias("bucket"),
        F.shiftright(spread, BUCKETS.bit_length() - 1).alias("slot"),
        *KEY,
        F.unix_micros("event_time").alias("at"),
        F.col("api_collection_ts_ms").alias("api_ms"),
        "source_sku",
        (F.col("price") * 100).cast("bigint").alias("cents"),
        "in_stock",
        "event_time",
    )
    money = lambda c: (F.col(c).cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")
    return (
        rows.groupBy("bucket")
        .transformWithStateInPandas(PricedBuckets(), OUT_DDL, outputMode="append", timeMode="EventTime")
        .select(
            *KEY,
            F.timestamp_micros("at").alias("event_time"),
            F.col("api_ms").alias("api_collection_ts_ms"),
            "source_sku",
            money("cents").alias("price"),
            "in_stock",
            money("previous").alias("previous_price"),
            money("low").alias("low_24h"),
        )
    )


def stream_previous_price(stream: DataFrame) -> DataFrame:
    """Watermarked prices with the previous price of the pair."""
    return stream_priced_pairs(stream).drop("low_24h")


def stream_low_24h(stream: DataFrame) -> DataFrame:
    """Watermarked prices with the lowest price of the pair over 24 hours."""
    return stream_priced_pairs(stream).drop("previous_price")
