"""Maximal periodic runs of words: synchronising positions propose periods, comparison confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import Words, column_bytes, mixed, powers, sliced

#: Periods below this are found by comparing all words that far apart; from here on each scale
#: tau = 8, 16, 32, ... proposes the periods from tau up to 2 tau.
DIRECT = 8
#: A run holds its period four times: only then is a synchronising position certain to lie in it.
EXPONENT = 4
_STEP = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
WORD = r"[^\x20\x09-\x0D]+"


class _Windows:
    """Hashes of windows of any width over one sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_STEP, n), out=self.sums[1:])
        self.back = powers(_BACK, n + 1)

    def at(self, starts: np.ndarray | slice, width: int) -> np.ndarray:
        if isinstance(starts, slice):
            stop = len(self.sums) - width
            return mixed((self.sums[width:] - self.sums[:stop]) * self.back[:stop])
        return mixed((self.sums[starts + width] - self.sums[starts]) * self.back[starts])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def synchronising_set(windows: _Windows, tau: int, regular: np.ndarray) -> np.ndarray:
    """Positions i where the window of width tau at i or at i + tau has the least hash of all between them.

    Membership depends on the 2 tau words from i on alone, so equal contexts are chosen alike.
    Windows in ``regular``, those of period tau / 4 at most, take no part: they would be chosen
    all along, and their periods are known from smaller scales. Any tau consecutive positions
    hold a chosen one unless all windows in reach are regular.
    """
    ids = windows.at(slice(None), tau)
    ids[regular[: len(ids)]] = _NONE
    least = _sliding_minimum(ids, tau + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((ids[:n] == least) | (ids[tau : tau + n] == least)))


def _proposals(values: np.ndarray, tau: int, regular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): neighbouring synchronising positions with equal contexts, tau to 2 tau apart."""
    windows = _Windows(values)
    chosen = synchronising_set(windows, tau, regular)
    context = windows.at(chosen, 2 * tau)
    order = np.lexsort((chosen, context))
    at, context = chosen[order], context[order]
    gap = np.diff(at)
    pick = (context[1:] == context[:-1]) & (gap >= tau) & (gap < 2 * tau)
    return at[:-1][pick], gap[pick]


def _agreement(values: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest [a, b) around ``at`` in which every word equals the one ``period`` later, compared in growing pieces."""
    n, b, step = len(values) - period, at, 64
    while b < n:
        stop = min(n, b + step)
        wrong = np.flatnonzero(values[b:stop] != values[b + period : stop + period])
        if wrong.size:
            b += int(wrong[0])
            break
        b, step = stop, step * 2
    a, step = at, 64
    while a > 0:
        start = max(0, a - step)
        wrong = np.flatnonzero(values[start:a] != values[start + period : a + period])
        if wrong.size:
            a = start + int(wrong[-1]) + 1
            break
        a, step = start, step * 2
    return a, b


def _directly(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Stretches [start, end) of each period below ``DIRECT`` that hold it four times."""
    for q in range(1, min(DIRECT, len(values))):
        edge = np.zeros(len(values) - q + 2, np.int8)
        edge[1:-1] = values[:-q] == values[q:]
        turns = np.flatnonzero(np.diff(edge))
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts >= (EXPONENT - 1) * q
        yield starts[long], ends[long] + q, q


def find_runs(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all maximal stretches that hold their smallest period four times.

    ``values`` are sequences, one after the other, each closed by a value that occurs nowhere
    else; ``bounds`` are their starts and the end. Work at scale tau is done on the sequences
    of at least 4 tau values only, and is linear there.

    A run of smallest period q from 8 on lies in scale tau <= q < 2 tau: its first
    3 q - 2 tau + 1 >= tau positions with their contexts hold a synchronising position i, i + q is one
    too, and no position between them has the same context, for the run would then have a
    smaller period.
    """
    found = [np.stack([s, e, np.full(len(s), q)], 1) for s, e, q in _directly(values)] or [np.zeros((0, 3), np.int64)]
    sizes = np.diff(bounds)
    tau = DIRECT
    while (long := sizes >= EXPONENT * tau + 1).any():
        part = np.repeat(long, sizes)
        home = np.flatnonzero(part)
        kept = values[home]
        # where windows lie within a run of period tau / 4 or less
        known = np.concatenate(found)
        known = known[(known[:, 2] * EXPONENT <= tau) & (known[:, 1] - known[:, 0] >= tau)]
        known = known[part[known[:, 0]]]
        marks = np.zeros(len(kept) + 1, np.int64)
        first = np.searchsorted(home, known[:, 0])
        np.add.at(marks, first, 1)
        np.add.at(marks, first + known[:, 1] - known[:, 0] - tau + 1, -1)
        at, period = _proposals(kept, tau, np.cumsum(marks[:-1]) > 0)
        more, last, reach = [], 0, 0
        for k in np.lexsort((at, period)):
            i, q = int(at[k]), int(period[k])
            if q == last and i < reach:
                continue  # within the stretch compared last
            a, reach = _agreement(kept, i, q)
            last = q
            if reach - a >= (EXPONENT - 1) * q:
                more.append((home[a], home[a] + reach - a + q, q))
        found.append(np.array(more, np.int64).reshape(-1, 3))
        tau *= 2
    runs = np.concatenate(found)
    # a stretch met under a multiple of its smallest period was met under that period before
    _, first = np.unique(runs[:, :2], axis=0, return_index=True)
    runs = runs[np.sort(first)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _struct_lists(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    fields = [pa.array(rows[:, j]) for j in range(3)]
    structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)


def _joined(data: np.ndarray, offsets: np.ndarray, words: Words, owner: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each document's kept words joined by one space: their bytes and the byte after each but the last, as a space."""
    index = np.flatnonzero(kept)
    inner = np.zeros(len(index), np.int64)
    inner[:-1] = owner[index[:-1]] == owner[index[1:]]
    spaced = data.copy()
    spaced[words.ends[index][inner == 1]] = 32
    delta = np.zeros(len(data) + 2, np.int8)
    delta[words.starts[index]] += 1
    delta[words.ends[index] + inner] -= 1
    mask = np.cumsum(delta, dtype=np.int8)[: len(data)] > 0
    ends = np.concatenate([[0], np.cumsum(mask)])[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(spaced[mask]))


def _searched(shortest: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for first, last in sliced(offsets):
                at = offsets[first : last + 1] - offsets[first]
                block = data[offsets[first] : offsets[last]]
                words = Words(block, at)
                counts = np.diff(words.bounds)
                docs = len(counts)
                owner = np.repeat(np.arange(docs), counts)
                bounds = words.bounds + np.arange(docs + 1)
                values = np.empty(bounds[-1], np.uint64)
                values[np.arange(len(owner)) + owner] = words.hashes()
                values[bounds[1:] - 1] = mixed(np.arange(docs, dtype=np.uint64) + np.uint64(0x51ED270B0A1F39C1))
                runs = find_runs(values, bounds)
                runs = runs[runs[:, 1] - runs[:, 0] >= shortest]
                home = np.searchsorted(bounds, runs[:, 0], "right") - 1
                delta = np.zeros(len(values) + 1, np.int64)
                np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
                np.add.at(delta, runs[:, 1], -1)
                repeated = (np.cumsum(delta[:-1]) > 0)[np.arange(len(owner)) + owner]
                rows = np.stack([runs[:, 0] - bounds[home], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
                columns = [
                    batch.column(0).slice(first, last - first),
                    pa.array(counts.astype(np.int64)),
                    _struct_lists(rows, np.bincount(home, minlength=docs)),
                    _joined(block, at, words, owner, ~repeated),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shortest: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of words in every whole text.

    Words are runs of bytes other than space and 0x09-0x0D. A run is a stretch of at least
    ``shortest`` words that holds its smallest period at least four times and that no
    neighbouring word extends; ``runs`` lists (start, length, period), words numbered from 0, by
    start, then period. ``collapsed`` joins by one space the words left when each run keeps only
    its first period; runs are judged on the input, not on what is left.

    One pass without a shuffle: a task holds about a megabyte of texts, or one longer text, and
    its work grows as n log n with the words of a text, however repetitive.

    Defined cases: a null text is empty, has no run and collapses to "". Ids play no part in
    the search, so null and repeated ones give a row each. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_searched(shortest), schema).withColumnRenamed("id", id)


def repeated_tail(id: Column, text: Column) -> Column:
    """The text with planted repetitions: where crc32(id) mod 10 is 0, words from a on cycle through p words.

    With g = crc32 div 10 and n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts,
    wordless ones and those without id stay as they are.
    """
    h = F.crc32(id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def cycled(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycled(w)).otherwise(text))
    return F.when(h % 10 == 0, F.get(bound, F.lit(0))).otherwise(text)


def run_digest(found: DataFrame) -> DataFrame:
    """Count, longest run and digests of a ``periodic_runs`` result."""
    # the greatest length, of equal ones the smallest start, then the smallest period
    keyed = F.transform(
        "runs",
        lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short")),
    )
    best = F.array_max(keyed)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    chosen = found.withColumns({"_best": best, "n_runs": F.size("runs").cast("long")})
    length, period = F.col("_best.length"), -F.col("_best.short")
    return chosen.select(
        "doc_id",
        "n_runs",
        (-F.col("_best.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
