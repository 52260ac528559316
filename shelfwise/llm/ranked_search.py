"""Ranked lexical search: sharded block-compressed postings searched by Block-Max MaxScore."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.blocks import Words, column_bytes, sliced
from shelfwise.llm.shared import settled, union

#: Postings in a compressed block, documents in a shard at most, and documents scored at a time.
BLOCK = 128
SHARD = 8192
STRIDE = 2048
#: Characters of item texts searched for in one pass over the index: the bound of what tasks are sent.
ITEM_CHARS = 8_000_000
#: Groups of heaps merged before the last merge.
MERGES = 64
_TERM = np.full(256, 32, np.uint8)
_TERM[48:58] = np.arange(48, 58)
_TERM[65:91] = np.arange(97, 123)
_TERM[97:123] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)
_WIDTHS = (np.uint8, np.uint16, np.uint32)

INDEX = (
    "ids array<long>, lengths array<long>, n_docs long, n_terms long, terms array<int>, dfs array<long>, "
    "last array<int>, places array<int>, fronts array<int>, front_tf array<long>, front_n array<long>, data binary"
)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, term bounds, term hashes) of blocks of rows; terms are letters of A-Z lowered, digits and non-ASCII."""
    data, offsets = column_bytes(column)
    for first, last in sliced(offsets):
        words = Words(_TERM[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
        yield first, last, words.bounds, words.hashes()


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """(width code, bytes) of non-negative values in the fewest bytes each."""
    top = int(values.max(initial=0))
    code = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return code, values.astype(_WIDTHS[code]).tobytes()


def _packed(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """A block of postings: two width codes, the steps between documents, the frequencies."""
    steps = np.diff(docs, prepend=0)
    (a, left), (b, right) = _narrow(steps), _narrow(tf)
    return bytes((a, b)) + left + right


def _unpacked(data: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = _WIDTHS[data[start]], _WIDTHS[data[start + 1]]
    n = (stop - start - 2) // (np.dtype(left).itemsize + np.dtype(right).itemsize)
    steps = np.frombuffer(data, left, n, start + 2)
    tf = np.frombuffer(data, right, n, start + 2 + steps.nbytes)
    return np.cumsum(steps, dtype=np.int64), tf.astype(np.int64)


def _shard(ids: list, counts: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """One index row. Beside each block stand its last document and its frontier: the (frequency, document
    length) pairs that no other pair of the block beats in both, whatever the collection's averages."""
    held, doc = np.unique(doc, return_inverse=True)
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    n = counts[held][doc]
    terms, starts, dfs = np.unique(term, return_index=True, return_counts=True)
    cuts = np.concatenate([np.arange(s, s + d, BLOCK) for s, d in zip(starts, dfs)]) if len(terms) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(doc))
    data = [_packed(doc[a:b], tf[a:b]) for a, b in zip(cuts, ends)]
    block = np.repeat(np.arange(len(cuts)), ends - cuts)
    order = np.lexsort((n, -tf, block))
    falling = n[order] - block[order] * (int(n.max(initial=0)) + 1)
    lowest = np.minimum.accumulate(falling)
    front = order[np.append(True, falling[1:] < lowest[:-1])] if len(order) else order
    places = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    chosen = pa.array(ids, pa.int64()).take(pa.array(held))
    whole = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chosen.to_pylist()], pa.list_(pa.int64())),
            whole(counts[held], pa.int64()),
            pa.array([int((counts > 0).sum())]),
            pa.array([int(counts.sum())]),
            whole(terms, pa.int32()),
            whole(dfs, pa.int64()),
            whole(doc[ends - 1] if len(cuts) else cuts, pa.int32()),
            whole(places, pa.int32()),
            whole(np.bincount(block[front], minlength=len(cuts)), pa.int32()),
            whole(tf[front], pa.int64()),
            whole(n[front], pa.int64()),
            pa.array([b"".join(data)], pa.binary()),
        ],
        [f.split()[0] for f in INDEX.split(", ")],
    )


def _indexing(vocabulary: np.ndarray):
    """Index rows over the terms whose hashes ``vocabulary`` holds in ascending order."""
    known = np.append(vocabulary, np.uint64(0))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, parts, base = [], [], [], 0

        def flush():
            doc, term, tf = (np.concatenate([p[j] for p in parts]) for j in range(3))
            return _shard(ids, np.concatenate(counts), doc, term, tf)

        for batch in batches:
            for first, last, bounds, hashes in _terms(batch.column(1)):
                if base and base + last - first > SHARD:
                    yield flush()
                    ids, counts, parts, base = [], [], [], 0
                at = np.searchsorted(vocabulary, hashes)
                hit = np.flatnonzero(known[at] == hashes) if len(vocabulary) else at[:0]
                owner = np.searchsorted(bounds, hit, "right") - 1
                key, tf = np.unique(owner * len(known) + at[hit], return_counts=True)
                parts.append((key // len(known) + base, key % len(known), tf))
                ids.extend(batch.column(0).slice(first, last - first).to_pylist())
                counts.append(np.diff(bounds))
                base += last - first
        if base:
            yield flush()

    return build


class _Postings:
    """One shard of the index, its blocks decompressed when first needed."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.m = lambda n: 10 + (90 * n * n_docs) // n_terms
        ids = row["ids"]
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.norm = self.m(np.array(row["lengths"], np.int64))
        dfs = np.array(row["dfs"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(-(-dfs // BLOCK))])
        self.slot = {t: j for j, t in enumerate(row["terms"])}
        self.last = np.array(row["last"], np.int64)
        self.places, self.data = row["places"], row["data"]
        fronts = np.array(row["fronts"], np.int64)
        tf, n = np.array(row["front_tf"], np.int64), np.array(row["front_n"], np.int64)
        at = np.cumsum(fronts) - fronts
        self.top = np.maximum.reduceat(self._impact(tf, self.m(n)), at) if len(at) else at
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if b not in self.open:
            docs, tf = _unpacked(self.data, self.places[b], self.places[b + 1])
            self.open[b] = docs, self._impact(tf, self.norm[docs])
        return self.open[b]


class _Heap:
    """The k best (score, id) of an item so far: by score, then id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.threshold = 1

    def push(self, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        score, id, null = np.append(self.score, score), np.append(self.id, id), np.append(self.null, null)
        best = np.lexsort((id, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], id[best], null[best]
        if len(best) == self.k:
            self.threshold = max(1, int(self.score[-1]))


def _search(shard: _Postings, terms: list[int], weights: dict[int, int], heap: _Heap) -> None:
    """Add the shard's documents to the heap unless they cannot reach its threshold.

    Lists stand by falling bound (weight times greatest impact). Those whose bounds together stay
    below the threshold are not essential: they propose no document. A document that the essential
    lists propose is given up as soon as its score so far and the block maxima of the rest stay below
    the threshold, before those blocks are decompressed. A score equal to the threshold goes on.
    """
    lists = []
    for t in terms:
        j = shard.slot.get(t)
        if j is not None and weights[t] > 0:
            a, b = int(shard.first[j]), int(shard.first[j + 1])
            tops = weights[t] * shard.top[a:b]
            lists.append((int(tops.max()), a, shard.last[a:b], tops, weights[t]))
    lists.sort(key=lambda x: -x[0])
    rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0)
    for start in range(0, len(shard.ids), STRIDE):
        stop = min(start + STRIDE, len(shard.ids))
        essential = int(np.count_nonzero(rest[:-1] >= heap.threshold))
        if not essential:
            return
        cuts = [np.searchsorted(last, (start, stop - 1)) for _, _, last, _, _ in lists]
        spans = [(int(lo), min(int(hi) + 1, len(x[2]))) for (lo, hi), x in zip(cuts, lists)]
        most = sum(int(x[3][lo:hi].max()) for (lo, hi), x in zip(spans, lists) if lo < hi)
        if most < heap.threshold:
            continue
        sums = np.zeros(stop - start, np.int64)
        for (lo, hi), (_, a, _, _, weight) in zip(spans[:essential], lists):
            for b in range(a + lo, a + hi):
                docs, impacts = shard.block(b)
                p, q = np.searchsorted(docs, (start, stop))
                sums[docs[p:q] - start] += weight * impacts[p:q]
        docs = np.flatnonzero(sums) + start
        score = sums[docs - start]
        found = []
        for _, a, last, tops, weight in lists[essential:]:
            at = np.searchsorted(last, docs)
            found.append((a, last, np.append(tops, 0), weight, at))
        above = score + sum((tops[at] for _, _, tops, _, at in found), np.zeros(len(docs), np.int64))
        live = np.flatnonzero(above >= heap.threshold)
        for a, last, tops, weight, at in found:
            if not live.size:
                break
            where = at[live]
            above[live] -= tops[where]
            for b in np.unique(where[where < len(last)]):
                among = live[where == b]
                held, impacts = shard.block(a + int(b))
                place = np.minimum(np.searchsorted(held, docs[among]), len(held) - 1)
                gain = np.where(held[place] == docs[among], weight * impacts[place], 0)
                score[among] += gain
                above[among] += gain
            live = live[above[live] >= heap.threshold]
        if live.size:
            chosen = docs[live]
            heap.push(score[live], shard.ids[chosen], shard.null[chosen])


def _searching(items: list[list[int]], weights: dict[int, int], n_docs: int, n_terms: int, k: int):
    """The k best documents of each item among a task's shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(k) for _ in items]
        for batch in batches:
            for j in range(batch.num_rows):
                shard = _Postings(batch.slice(j, 1).to_pylist()[0], n_docs, n_terms)
                for terms, heap in zip(items, heaps):
                    _search(shard, terms, weights, heap)
        sizes = [len(h.score) for h in heaps]
        if sum(sizes):
            columns = [
                pa.array(np.repeat(np.arange(len(items)), sizes)),
                pa.array(np.concatenate([h.id for h in heaps]), mask=np.concatenate([h.null for h in heaps])),
                pa.array(np.concatenate([h.score for h in heaps])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return search


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(docs: DataFrame, block: list, k: int) -> DataFrame:
    """Results of the items in ``block`` (rows of id and text)."""
    spark = docs.sparkSession
    wanted = [np.zeros(0, np.uint64) for _ in block]
    for first, last, bounds, hashes in _terms(pa.array([r["text"] for r in block], pa.large_string())):
        for j in range(first, last):
            wanted[j] = np.unique(hashes[bounds[j - first] : bounds[j - first + 1]])
    vocabulary = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
    index = settled(docs.mapInArrow(_indexing(vocabulary), INDEX))
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # as many rows as the block's items have terms
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect()
    weights = {r["terms"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in counted}
    items = [[t for t in np.searchsorted(vocabulary, w).tolist() if t in weights] for w in wanted]
    heaps = index.mapInArrow(_searching(items, weights, n_docs, n_terms, k), "item long, doc_id long, score long")
    merged = _best(heaps.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGES))), ["item", "part"], k)
    names = spark.createDataFrame([(j, r["id"]) for j, r in enumerate(block)], "item long, item_id long")
    return _best(merged.select("item", "doc_id", "score"), ["item"], k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above score 0 for each item, all documents searched.

    Terms are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. With N the
    documents that hold a term, L their terms with repeats, n a document's, df the documents that
    hold a term and tf its occurrences in one: w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    m = 10 + 90 n N div L, and a document scores the sum of w * (10^9 tf div (1000 tf + 8 m)) over an
    item's different terms. Equal scores rank by id.

    The documents are read once into an index of shards, compressed postings of the terms that
    items ask for; counts cover all documents. Every task searches its shards by Block-Max
    MaxScore with one heap an item, carried from shard to shard; the heaps are merged in two
    steps. Items beyond ``ITEM_CHARS`` characters together go in several passes, so what tasks
    are sent stays bounded.

    Defined cases: a null or termless text is no result and not counted in N; an item without terms
    has no result. Rows that repeat a doc_id, or lack it, are documents of their own and ranked each,
    those without id after equal scores with one. Item rows that repeat an id are ranked each. Other columns are
    ignored.
    """
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    asked = settled(asked)
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // ITEM_CHARS))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(passes)))
    return union(*[_searched(docs, dealt.filter(F.col("part") == p).collect(), k) for p in range(passes)])
