"""Benchmark passages in documents, edits included: q-gram lemma filter and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import BLOCK_BYTES, column_bytes, mixed, sliced
from shelfwise.llm.shared import narrowed, settled, union

Q = 8
WINDOW = 64
EDITS = 5
CHUNK = 128
ITEM_CHARS = 2_000_000
#: Candidates aligned at a time: the table rows of these are held, a few times over.
ALIGNED = 1 << 14
_BITS = 22
_BASE = 0xD6E8FEB86659FD93
PAIRS = "doc_id long, item_id long, start long, end long, n_windows int, edits int"


class Normaliser:
    """Letters and digits lowered, every other run of characters one space."""

    def __init__(self):
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
        self.solid = np.array([c.isalnum() for c in chars])
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)

    def __call__(self, codes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(normalised code points, their places in ``codes``); no blank reaches over one of the text ``starts``."""
        small = codes < (1 << 16)
        low = np.where(small, codes, 0).astype(np.uint16)
        solid = self.solid[low] | ~small
        after = np.ones(len(codes), bool)
        after[1:] = ~solid[:-1]
        if starts is not None:
            after[starts[starts < len(codes)]] = False
        place = np.flatnonzero(solid | ~after)
        out = np.where(small, self.lower[low], codes)[place]
        out[~solid[place]] = 32
        return out, place


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``Q`` = 8 code points, by doubling."""
    h, base = codes.astype(np.uint64), _BASE
    for _ in range(3):
        size = len(codes) - len(h) + 1
        if len(h) <= size:
            return np.zeros(0, np.uint64)
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base % (1 << 64)
    return mixed(h)


def lemma(length: int, edits: int) -> int:
    """Grams that ``length`` characters keep at least under ``edits`` edits: each edit destroys Q of them at most."""
    return length + 1 - Q - edits * Q


@dataclass
class Items:
    """A block of items, their windows, and the places of their grams.

    Window s of an item of more than WINDOW characters is its characters s to s + WINDOW, for every
    s; a shorter item is one window.
    """

    ids: np.ndarray
    start: np.ndarray  # where an item's text starts in ``text``
    size: np.ndarray  # length of its windows
    count: np.ndarray  # how many it has
    edits: np.ndarray  # edit budget of a window
    text: np.ndarray  # code points of all items
    grams: np.ndarray  # distinct gram hashes, ordered
    cuts: np.ndarray  # places of gram g: cuts[g]:cuts[g + 1] of the next two
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # bitmap of the grams' high bits


def compiled(items: list[tuple[int, str]]) -> Items | None:
    """The items of at least ``Q`` characters; shorter ones hold no gram."""
    normal = Normaliser()
    ids, rows = [], []
    for item, text in items:
        codes, _ = normal(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))
        codes = codes[1:] if len(codes) and codes[0] == 32 else codes
        codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
        if len(codes) >= Q:
            ids.append(item)
            rows.append(codes)
    if not rows:
        return None
    length = np.array([len(r) for r in rows])
    grams = [gram_hashes(r) for r in rows]
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    distinct, cuts = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    size = np.minimum(length, WINDOW)
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    return Items(
        np.array(ids), np.cumsum(length) - length, size, length - size + 1, size * EDITS // WINDOW, np.concatenate(rows),
        distinct, np.append(cuts, len(flat)), item[order], place[order], seen,
    )


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... ``n`` times each, one row after the other."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def candidates(codes: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, window, lowest diagonal) of every window and diagonal band of a block that may match; ``ends`` are the documents'.

    A match of a window within e edits keeps ``lemma`` of its grams, all on e + 1 neighbouring
    diagonals (document place - item place) and within the window's length and e more in the
    document. Bands of 2 (e + 1) diagonals begin every e + 1, so some band holds them all. Along a band
    the hits stand by item place: windows qualify whose places hold ``lemma`` of them. Items with too
    few grams in two neighbouring chunks of the document are left out before that.
    """
    hashes = gram_hashes(codes)
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none, none, none
    at = np.flatnonzero(items.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
    g = np.searchsorted(items.grams, hashes[at])
    same = items.grams[np.minimum(g, len(items.grams) - 1)] == hashes[at]
    inside = np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + Q - 1, "right")
    at, g = at[same & inside], g[same & inside]
    n = items.cuts[g + 1] - items.cuts[g]
    hit = _spread(items.cuts[g], n)
    at, item, place = np.repeat(at, n), items.item[hit], items.place[hit]
    if not len(at):
        return none, none, none, none
    need = np.maximum(lemma(items.size, items.edits), 1)
    many = len(items.ids)
    keys, inverse, counts = np.unique(at // CHUNK * many + item, return_inverse=True, return_counts=True)
    near = counts.copy()
    for step in (-1, 1):
        found = np.minimum(np.searchsorted(keys, keys + step * many), len(keys) - 1)
        near += np.where(keys[found] == keys + step * many, counts[found], 0)
    stay = near[inverse] >= need[item]
    at, item, place = at[stay], item[stay], place[stay]
    if not len(at):
        return none, none, none, none
    diagonal = at - place
    band = np.concatenate([diagonal // (items.edits[item] + 1), diagonal // (items.edits[item] + 1) - 1])
    doc, item, place = np.tile(np.searchsorted(ends, at, "right"), 2), np.tile(item, 2), np.tile(place, 2)
    band_low, bands = band.min(), np.ptp(band) + 1
    keys = (doc * bands + band - band_low) * many + item
    order = np.lexsort((place, keys))
    keys, doc, item, place, band = keys[order], doc[order], item[order], place[order], band[order]
    # hits k and k + need - 1 of a band within one window's gram places: the windows that hold both
    last = np.arange(len(keys)) + need[item] - 1
    row = np.flatnonzero(last < len(keys))
    reach = items.size[item[row]] - Q + 1
    row = row[(keys[last[row]] == keys[row]) & (place[last[row]] - place[row] < reach)]
    low = np.maximum(place[last[row]] - (items.size[item[row]] - Q), 0)
    high = np.minimum(place[row], items.count[item[row]] - 1)
    n = np.maximum(high - low + 1, 0)
    window, source = _spread(low, n), np.repeat(row, n)
    # one row for a window and two neighbouring bands: a match lies in both as a rule
    which = doc[source] * many + item[source]
    order = np.lexsort((band[source], window, which))
    which, window, source = which[order], window[order], source[order]
    lane = band[source]
    step = np.full(len(lane), 2)
    step[1:] = np.where((which[1:] == which[:-1]) & (window[1:] == window[:-1]), lane[1:] - lane[:-1], 2)
    stay = np.flatnonzero(step != 0)
    window, source, step = window[stay], source[stay], step[stay]
    begin = np.flatnonzero(step != 1)
    nth = np.arange(len(step)) - np.repeat(begin, np.diff(np.append(begin, len(step))))
    window, source = window[nth % 2 == 0], source[nth % 2 == 0]
    return doc[source], item[source], window, band[source] * (items.edits[item[source]] + 1)


def aligned(
    codes: np.ndarray, first: np.ndarray, last: np.ndarray, item: np.ndarray, window: np.ndarray, lowest: np.ndarray, items: Items
) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end place) of the best match of each window within two bands and its document, both ends there free.

    The document is ``codes[first:last]``; ``lowest`` is the first band's first diagonal between ``codes`` and the item.
    """
    if not len(item):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(item) > ALIGNED:
        parts = [slice(k, k + ALIGNED) for k in range(0, len(item), ALIGNED)]
        done = [aligned(codes, first[p], last[p], item[p], window[p], lowest[p], items) for p in parts]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    most = int(items.edits[item].max())
    width = 3 * (most + 1) + 2 * most + 1
    begin = lowest + window - most  # where the band's first column meets the window's first character
    columns = np.arange(width)
    source = items.start[item] + window
    cost = np.zeros((len(item), width), np.int16)
    done = cost.copy()
    for i in range(int(items.size[item].max())):
        live = items.size[item] > i
        at = begin[:, None] + i + columns
        inside = (at >= first[:, None]) & (at < last[:, None])
        text = codes[np.clip(at, 0, len(codes) - 1)]
        letter = items.text[np.minimum(source + i, len(items.text) - 1)]
        step = cost + ((text != letter[:, None]) | ~inside)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = (np.minimum.accumulate(step - columns, axis=1) + columns).astype(np.int16)
        done[live] = cost[live]
    best = done.argmin(axis=1)
    return done[np.arange(len(item)), best].astype(np.int64), begin + best + items.size[item]


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, normal = shared.value, Normaliser()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for a, b in sliced(offsets, BLOCK_BYTES // 2):
                block, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                codes = np.frombuffer(block.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                # counted row by row: a running count over all bytes of a batch takes eight times its size, twice
                leads = (block & 0xC0) != 0x80
                starts = np.cumsum([0, *(np.count_nonzero(leads[x:y]) for x, y in zip(at[:-1], at[1:]))])
                short, place = normal(codes, starts)
                bounds = np.searchsorted(place, starts)
                doc, item, window, lowest = candidates(short, bounds[1:], items)
                edits, end = aligned(short, bounds[doc], bounds[doc + 1], item, window, lowest, items)
                good = edits <= items.edits[item]
                doc, item, window, edits, end = doc[good], item[good], window[good], edits[good], end[good]
                first = np.clip(end - items.size[item], bounds[doc], bounds[doc + 1] - 1)
                end = np.clip(end, first + 1, bounds[doc + 1])
                found: dict[tuple, list] = {}
                for d, k, w, e, x, y in zip(*(v.tolist() for v in (doc, item, window, edits, first, end))):
                    origin = int(starts[d])
                    x, y = int(place[x]) - origin, int(place[y - 1]) - origin + 1
                    one = found.setdefault((d, int(items.ids[k])), [x, y, set(), e])
                    one[:2], one[3] = [min(one[0], x), max(one[1], y)], min(one[3], e)
                    one[2].add(w)
                for (d, item), (x, y, windows, e) in found.items():
                    out.append((ids[a + d], item, max(x, 0), min(y, int(starts[d + 1] - starts[d])), len(windows), e))
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "n_windows", "edits"])

    return run


def _item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items streamed in blocks of some ``most`` characters; one longer item is a block of its own."""
    block, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=True):
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = ITEM_CHARS
) -> DataFrame:
    """(doc_id, item_id, start, end, n_windows, edits): every document and benchmark item that share a passage.

    Texts are lowered and all that is no letter or digit counts as one space. A document holds an
    item when some 64-character window of the item, wherever it starts, stands in it with at most 5
    edits; a shorter item must stand in it whole, with edits in proportion, rounded down. ``start`` and
    ``end`` are the characters of the document that the matching windows span, to within the
    edits; ``edits`` is the least of them.

    The items are the query set: they go in blocks of ``block_chars`` characters, each sent to all
    tasks once (a bounded size) and compared with every document in one pass.

    Defined cases: null or empty texts hold nothing; items under 8 characters hold no 8-gram and match
    nothing; items without id are searched too, their id null reads -1; a document
    without id is reported with a null id; repeated rows are reported each; other columns are
    ignored; without items or documents the result is empty.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    query = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("long"), F.lit(-1)).alias("item"), F.col(f"`{item_text}`").alias("text"))
    found = []
    for block in _item_blocks(query, block_chars):
        if ready := compiled(block):
            found.append(slim.mapInArrow(_searched(spark.sparkContext.broadcast(ready)), PAIRS))
    if not found:
        return spark.createDataFrame([], PAIRS)
    if len(found) == 1:
        return found[0]
    # an item's windows never fall into two blocks, so the blocks' rows are apart
    return union(*[settled(f) for f in found])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage; every row is judged by its own text, found again by its hash."""
    marked = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    keyed = marked.select(F.col("__row").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bad = settled(benchmark_passages(keyed, benchmark).select(F.col("doc_id").alias("__row")).distinct())
    return narrowed(marked.join(bad, "__row", "left_anti"), *docs.columns)
