"""Passages that several documents share, brought together by content-chosen anchors.

Suffix-array and substring dedup ask the same question: which windows of ``width`` units (bytes or
words) also start in a document with a smaller id? No task can hold the collection, so windows
that may be equal must meet. Of the grams inside a window the one with the smallest hash is its
anchor; equal windows have equal anchors. Only anchors found in two different texts matter:

1. every block of documents counts its anchors and sends each once to the anchor's bucket, which
   answers the documents whose anchor other texts hold too; what repeats inside a block needs no
   answer, so an anchor in a third of all documents costs one entry a block;
2. documents with such anchors are read again, and the stretch of text around each (all windows
   with that anchor, some 60 bytes) goes once a block to the anchor's shard;
3. a shard collapses equal stretches, compares those that differ around one anchor by the method
   of the operator, and answers each block with the smallest document id of every window;
4. the block marks, in each of its documents, the windows whose id is smaller than its own.

Equal texts are one member of the collection, under their smallest id; the later copies are
covered whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.blocks import _BYTES, _INVERSE, _STEP, Words, column_bytes, mixed, powers, runs_of, sliced
from shelfwise.llm.shared import partitions, settled

# Bytes of text hashed at once; a longer document is hashed alone.
HASHED = 1 << 20
# Bytes of text in a block for each bucket it writes to, and at most: a block sends one message to a bucket, so blocks grow
# with the buckets, or the messages would grow with the square of the input.
EACH, BLOCK = 1 << 14, 1 << 24
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)

# (stretches of one shard, smallest id of each, windows' width) -> smallest id of each window, per stretch
Method = Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]


@dataclass(frozen=True)
class Bytes:
    """Units are the bytes of the UTF-8 text."""

    width: int
    gram: int

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64), offsets
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(_STEP, len(data)), out=sums[1:])
        return mixed((sums[self.gram :] - sums[:n]) * powers(_INVERSE, n)), offsets

    def units(self, text: bytes):
        return text

    def cut(self, units, first: int, last: int) -> bytes:
        return units[first:last]

    def joined(self, parts: list) -> bytes:
        return b"".join(parts)

    def windows(self, stretch: bytes) -> int:
        return len(stretch) - self.width + 1


@dataclass(frozen=True)
class WordUnits:
    """Units are words: runs of bytes other than 0x20 and 0x09-0x0D, unchanged."""

    width: int
    gram: int

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, offsets)
        return runs_of(words.hashes(), self.gram), words.bounds

    def units(self, text: bytes):
        return text.split()

    def cut(self, units, first: int, last: int) -> bytes:
        return b" ".join(units[first:last])

    def joined(self, parts: list) -> bytes:
        return b" ".join(w for part in parts for w in part)

    def windows(self, stretch: bytes) -> int:
        return stretch.count(b" ") + 2 - self.width


def anchor_runs(grams: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first window, last window) of every run of windows with the same anchor.

    A window's anchor is its gram with the smallest hash, the last such gram on a tie; which one
    that is depends on the window's content alone. Windows never cross a document's end.
    """
    n, span = int(bounds[-1]), width - gram + 1
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    least = (grams & _HIGH) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - width + 1
    whole = last > first
    np.add.at(inside, first[whole], 1)
    np.add.at(inside, last[whole], -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    s0, s1 = np.flatnonzero(new), np.flatnonzero(ends)
    return np.searchsorted(bounds, s0, "right") - 1, grams[place[s0]], s0, s1


def block_bytes(buckets: int) -> int:
    return min(max(HASHED, buckets * EACH), BLOCK)


def _runs_of_block(units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``anchor_runs`` of a block of documents and the bounds of their units, hashed a slice at a time."""
    found, bounds, base = [], [np.zeros(1, np.int64)], 0
    for a, b in sliced(offsets, HASHED):
        grams, own = units.grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        doc, hashes, s0, s1 = anchor_runs(grams, own, units.width, units.gram)
        found.append((doc + a, hashes, s0 + base, s1 + base))
        bounds.append(own[1:] + base)
        base += int(own[-1])
    return *(np.concatenate(x) for x in zip(*found)), np.concatenate(bounds)


def _short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number above 32 further bits of the hash."""
    return ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that bring equal keys together, the first key leading."""
    order = np.lexsort(keys[::-1])
    change = np.ones(len(order), bool)
    if len(order):
        change[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(change)


def _several(texts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of ``texts`` (ordered, from ``starts``): whether it holds two different values."""
    if not len(starts):
        return np.zeros(0, bool)
    return np.minimum.reduceat(texts, starts) != np.maximum.reduceat(texts, starts)


def _by_document(ids: np.ndarray, shorts: np.ndarray) -> tuple[list[int], list[bytes]]:
    order, starts = _groups(ids)
    parts = np.split(shorts[order], starts[1:]) if len(starts) else []
    return ids[order][starts].tolist(), [p.tobytes() for p in parts]


_SENT = "bucket int, id long, part binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "id", "part"])


def _announce(units, buckets: int):
    """Step 1 in the block: anchors to their buckets, and (with an id) answers the block can give itself, which any bucket passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in sliced(offsets, block_bytes(buckets)):
                doc, hashes, _, _, _ = _runs_of_block(units, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order, starts = _groups(texts[a:b], ids[a:b])
                order = order[starts]  # of equal texts only the one with the smallest id speaks
                speaks = np.zeros(b - a, bool)
                speaks[order[np.concatenate([[True], np.diff(texts[a:b][order]) != 0])[: len(order)]]] = True
                doc, shorts = doc[speaks[doc]], _short(hashes[speaks[doc]], buckets)
                order, starts = _groups(shorts, doc)  # a document's anchor counts once
                doc, shorts = doc[order][starts], shorts[order][starts]
                of, text = ids[a:b][doc], texts[a:b][doc]
                heads = np.flatnonzero(np.concatenate([[True], shorts[1:] != shorts[:-1]])) if len(shorts) else starts
                many = _several(text, heads)
                sizes = np.diff(np.append(heads, len(shorts)))
                local = np.repeat(many, sizes)
                rows = [(i % buckets, i, p) for i, p in zip(*_by_document(of[local], shorts[local]))]
                single = ~local
                known = shorts[heads][many]
                at = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
                cuts, known_cuts = np.searchsorted(shorts, at), np.searchsorted(known, at)
                for k in range(buckets):
                    part = slice(cuts[k], cuts[k + 1])
                    mine = single[part]
                    told = known[known_cuts[k] : known_cuts[k + 1]]
                    if not (mine.any() or len(told)):
                        continue
                    o, s, t = of[part][mine], shorts[part][mine], text[part][mine]
                    order, starts = _groups(o, t)
                    counts = np.diff(np.append(starts, len(order))).astype(np.uint32)
                    low = (s[order] & _LOW).astype(np.uint32)
                    rows.append((k, None, _pack(o[order][starts], t[order][starts], counts, low, (told & _LOW).astype(np.uint32))))
                yield _sent(rows)

    return run


def _answer(slots: int):
    """Step 1 in the bucket: for each document its anchors that a different text holds too, packed by slots of documents."""

    def run(table: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        ids, texts, lows, told = [none], [none], [none.astype(np.uint32)], [none.astype(np.uint32)]
        bucket = table.column("bucket")[0].as_py()
        given = table.filter(pc.is_valid(table.column("id")))
        for part in table.filter(pc.is_null(table.column("id"))).column("part"):
            i, t, n, low, many = _unpack(part.as_buffer(), "i8", "i8", "u4", "u4", "u4")
            ids.append(np.repeat(i, n))
            texts.append(np.repeat(t, n))
            lows.append(low)
            told.append(many)
        i, t, low = (np.concatenate(x) for x in (ids, texts, lows))
        order, starts = _groups(low)
        shared = _several(t[order], starts) | np.isin(low[order][starts], np.unique(np.concatenate(told)))
        keep = order[np.repeat(shared, np.diff(np.append(starts, len(order))))]
        own = [np.frombuffer(part.as_buffer(), np.uint64) for part in given.column("part")]
        sizes = np.array([len(x) for x in own], np.int64)
        who = np.concatenate([i[keep], np.repeat(given.column("id").to_numpy(), sizes)])
        shorts = np.concatenate([low[keep].astype(np.uint64) | np.uint64(bucket << 32), *own])
        slot = (mixed(who.astype(np.uint64)) % np.uint64(slots)).astype(np.int32)
        order, starts = _groups(slot)
        parts = [_pack(who[x], shorts[x]) for x in (np.split(order, starts[1:]) if len(starts) else [])]
        return pa.table({"slot": pa.array(slot[order][starts], pa.int32()), "part": pa.array(parts, pa.binary())})

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """All shared anchors of each document of a slot."""
    parts = [_unpack(part.as_buffer(), "i8", "u8") for part in table.column("part")]
    who, found = _by_document(*(np.concatenate(x) for x in zip(*parts)))
    return pa.table({"id": pa.array(who, pa.int64()), "part": pa.array(found, pa.binary())})


_ASKED = "kind int, block string, shard int, part binary, ids array<long>, t1 array<long>, t2 array<long>, texts binary"


def _ask(units, buckets: int, shards: int):
    """Step 2: stretches around shared anchors to their shards (kind 0), and the block itself (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            ids, t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for a, b in sliced(offsets, block_bytes(shards)):
                local = offsets[a : b + 1] - offsets[a]
                doc, hashes, s0, s1, bounds = _runs_of_block(units, data[offsets[a] : offsets[b]], local)
                shorts = _short(hashes, buckets)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                whole = data[offsets[a] : offsets[b]].tobytes()
                contents: dict[bytes, int] = {}
                shard_of: list[int] = []
                anchor: list[int] = []
                lowest: list[int] = []
                highest: list[int] = []
                found: list[tuple[int, int, int]] = []
                shard = ((hashes >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
                for d in range(b - a):
                    own = slice(cuts[d], cuts[d + 1])
                    shared = np.frombuffer(batch.column(4)[a + d].as_buffer(), np.uint64)
                    pick = np.flatnonzero(np.isin(shorts[own], shared)) + cuts[d]
                    text, base, me = units.units(whole[local[d] : local[d + 1]]), int(bounds[d]), int(ids[a + d])
                    for r in pick.tolist():
                        first = int(s0[r]) - base
                        stretch = units.cut(text, first, int(s1[r]) - base + units.width)
                        g = contents.setdefault(stretch, len(contents))
                        if g == len(shard_of):
                            shard_of.append(int(shard[r]))
                            anchor.append(int(hashes[r]))
                            lowest.append(me)
                            highest.append(me)
                        elif me < lowest[g]:
                            lowest[g] = me
                        elif me > highest[g]:
                            highest[g] = me
                        found.append((d, g, first))
                block = uuid.uuid4().hex
                of, low, high = np.array(shard_of, np.int64), np.array(lowest, np.int64), np.array(highest, np.int64)
                by = np.array(anchor, np.uint64)
                texts = list(contents)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shards + 1))
                rows: list[tuple] = []
                for k in range(shards):
                    mine = order[cuts[k] : cuts[k + 1]]
                    if len(mine):
                        joined = [texts[g] for g in mine.tolist()]
                        sizes = np.array([len(x) for x in joined], np.int64)
                        rows.append((0, block, k, packer.compress(_pack(sizes, low[mine], high[mine], by[mine]) + b"".join(joined)), None, None, None, None))
                places = np.array(found, np.int64).reshape(-1, 3)
                held = pa.array([None] * len(rows) + [packer.compress(whole)], pa.binary())
                rows.append((1, block, None, _pack(of, places.ravel(), local), ids[a:b].tolist(), t1[a:b].tolist(), t2[a:b].tolist(), None))
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
                columns = [pa.array(c, k) for c, k in zip(zip(*[r[:7] for r in rows]), kinds)]
                yield pa.RecordBatch.from_arrays([*columns, held], ["kind", "block", "shard", "part", "ids", "t1", "t2", "texts"])

    return run


def _compare(width: int, windows_of: Callable[[bytes], int], method: Method):
    """Step 3: the shard's distinct stretches through the operator's method; runs of windows with one smallest id go back."""

    def run(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        contents: dict[bytes, int] = {}
        lowest: list[int] = []
        anchors: list[int] = []
        asked = []
        for part in table.column("part"):
            data = unpacker.decompress(part.as_py())
            sizes, low, high, by = _unpack(data, "i8", "i8", "i8", "u8")
            at = 32 + 32 * len(sizes)
            which = []
            for n, me, anchor in zip(sizes.tolist(), low.tolist(), by.tolist()):
                g = contents.setdefault(data[at : at + n], len(contents))
                at += n
                if g == len(lowest):
                    lowest.append(me)
                    anchors.append(anchor)
                elif me < lowest[g]:
                    lowest[g] = me
                which.append(g)
            asked.append((which, high))
        _, group, sizes = np.unique(np.array(anchors, np.uint64), return_inverse=True, return_counts=True)
        contested = np.flatnonzero(sizes[group] > 1).tolist()
        texts = list(contents)
        windows = method([texts[g] for g in contested], np.array(lowest, np.int64)[contested], width)
        # a stretch alone with its anchor is the same wherever it stands: one smallest id for all its windows
        runs: list = [([0], [windows_of(t)], [me]) for t, me in zip(texts, lowest)]
        for g, w in zip(contested, windows):
            heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            runs[g] = (heads.tolist(), [*heads[1:].tolist(), len(w)], w[heads].tolist())
        answers = []
        for which, high in asked:
            rows = []
            for i, (g, top) in enumerate(zip(which, high.tolist())):
                rows.extend((i, x, y, m) for x, y, m in zip(*runs[g]) if m < top)
            answers.append(np.array(rows, np.int64).tobytes())
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(answers, pa.binary())})

    return run


def _covered(places: np.ndarray, of: np.ndarray, ids: np.ndarray, answers: list[dict], width: int) -> np.ndarray:
    """(document, first unit, end unit) of every covered stretch of the block, by document and place."""
    order = np.argsort(places[:, 1], kind="stable")
    places = places[order]
    by_shard = np.argsort(of, kind="stable")
    shards = of[by_shard]
    out = []
    for answer in answers:
        runs = np.frombuffer(answer["answer"], np.int64).reshape(-1, 4)
        if not len(runs):
            continue
        g = by_shard[np.searchsorted(shards, answer["shard"]) + runs[:, 0]]
        a, b = np.searchsorted(places[:, 1], g), np.searchsorted(places[:, 1], g, "right")
        n = b - a
        run = np.repeat(np.arange(len(runs)), n)
        hit = places[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        later = ids[hit[:, 0]] > runs[run, 3]
        hit, run = hit[later], run[later]
        out.append(np.stack([hit[:, 0], hit[:, 2] + runs[run, 1], hit[:, 2] + runs[run, 2] - 1 + width], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of ordered (first, end) spans; touching ones are one."""
    out: list[list[int]] = []
    for a, b in spans.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _mark(units):
    """Step 4: each document of the block with its covered units removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                of, places, local = _unpack(row["part"], "i8", "i8", "i8")
                whole = unpacker.decompress(row["texts"])
                ids = np.array(row["ids"], np.int64)
                found = _covered(places.reshape(-1, 3), of, ids, row["answers"] or [], units.width)
                cuts = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
                for d in range(len(ids)):
                    spans = merged(found[cuts[d] : cuts[d + 1], 1:])
                    body = units.units(whole[local[d] : local[d + 1]])
                    edges = [0, *(x for s in spans for x in s), len(body)]
                    kept = units.joined([body[a:b] for a, b in zip(edges[::2], edges[1::2])])
                    values = (row["ids"][d], row["t1"][d], row["t2"][d], sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s])
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "t1", "t2", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove_shared(docs: DataFrame, units, method: Method, *, id: str, text: str, count: Column, whole: Column) -> DataFrame:
    """(id, n_units, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    ``count`` and ``whole`` give a text's units and its digest when nothing is removed, from the
    column ``text``. ``spans`` lists the removed runs as first, end, first, end, ... in units.
    """
    buckets = shards = partitions(docs)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.col(f"`{id}`").cast("long").alias("id"), body.alias("text"))
    keyed = named.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.length("text"), "text").alias("t2"), "text")
    base = settled(keyed.select("id", "t1", "t2", count.cast("long").alias("n_units"), whole.alias("whole")))
    long_enough = base.filter(F.col("id").isNotNull() & (F.col("n_units") >= units.width))
    keys = ["id", "t1", "t2"]

    groups = settled(long_enough.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last"))
    later = settled(long_enough.join(groups, ["t1", "t2"]).filter("id > rep").select(keys).distinct())

    able = keyed.filter(F.col("id").isNotNull())
    sent = able.select("id", "t1", "text").mapInArrow(_announce(units, buckets), _SENT)
    answered = sent.groupBy("bucket").applyInArrow(_answer(8 * buckets), "slot int, part binary")
    parts = answered.groupBy("slot").applyInArrow(_gathered, "id long, part binary")
    wanted = settled(parts.join(long_enough.select(keys).distinct(), "id").join(later, keys, "left_anti").select(*keys, "part"))

    chosen = able.join(wanted, keys).select(*keys, "text", "part")
    asked = settled(chosen.mapInArrow(_ask(units, buckets, shards), _ASKED))
    answers = (
        asked.filter("kind = 0")
        .select("block", "shard", "part")
        .groupBy("shard")
        .applyInArrow(_compare(units.width, units.windows, method), "block string, shard int, answer binary")
    )
    replies = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))
    blocks = asked.filter("kind = 1").select("block", "part", "ids", "t1", "t2", "texts").join(replies, "block", "left")
    marks = "id long, t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    marked = settled(blocks.mapInArrow(_mark(units), marks).dropDuplicates(keys))

    copy = F.col("copy").isNotNull()
    return (
        base.join(marked, keys, "left")
        .join(later.withColumn("copy", F.lit(1)), keys, "left")
        .select(
            "id",
            "n_units",
            F.when(copy, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
            F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_units"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        )
    )
