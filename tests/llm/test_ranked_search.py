"""Ranked search against scoring every document, at small shards so that all paths are taken."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import ranked_search as module
from shelfwise.llm.ranked_search import _packed, _unpacked, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


@pytest.fixture
def small(monkeypatch):
    """Shards, blocks and strides of a few documents."""
    for name, value in (("BLOCK", 8), ("SHARD", 64), ("STRIDE", 16)):
        monkeypatch.setattr(module, name, value)


def collection(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "日本", "x9"]
    pick = lambda: words[min(int(rng.expovariate(0.02)), len(words) - 1)]
    docs = [(rng.randrange(10**6), rng.choice([" ", ", ", "\x00-", "\n"]).join(pick() for _ in range(rng.choice([1, 5, 40, 200])))) for _ in range(n)]
    items = [(i, " ".join(pick().upper() for _ in range(rng.choice([1, 4, 30])))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_ranking(spark, small, k):
    docs, items = collection(2, 700)
    docs += [(5, "w1 w2 w2"), (5, "w1 w2 w2"), (None, "w1 w2 w2"), (7, None), (8, " .-"), (-3, "W1 w2 w2 ")]
    items += [(77, None), (78, ""), (79, "nowhere"), (None, "w1 w2"), (3, "w2 w1 w2")]
    got = ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=k
    ).collect()
    order = lambda r: (str(r[0]), r[1], r[3], str(r[2]))
    assert sorted(map(tuple, got), key=order) == sorted(plain_ranking(docs, items, k), key=order)


def test_items_in_passes(spark, monkeypatch):
    docs, items = collection(3, 150)
    monkeypatch.setattr(module, "ITEM_CHARS", 500)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ranked_search(d, i, k=3).collect())) == sorted(plain_ranking(docs, items, 3))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, score string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0 == ranked_search(docs, items.limit(0)).count()
    assert [r["doc_id"] for r in ranked_search(docs, items).collect()] == [1]


def test_blocks_stay_closed(small):
    """Block maxima give up documents before the blocks of frequent terms are decompressed."""
    rng = np.random.default_rng(1)
    n = 4000
    doc, term, tf = [], [], []
    for t, share in ((0, 0.9), (1, 0.8), (2, 0.01)):
        held = np.flatnonzero(rng.random(n) < share)
        doc.append(held)
        term.append(np.full(len(held), t))
        tf.append(rng.integers(1, 4, len(held)))
    columns = [np.concatenate(x) for x in (doc, term, tf)]
    batch = module._shard(list(range(n)), np.full(n, 50), *columns)
    shard = module._Postings(batch.to_pylist()[0], n, 50 * n)
    weights = {0: 105, 1: 223, 2: 4600}
    heap, every = module._Heap(5), module._Heap(5)
    module._search(shard, [0, 1, 2], weights, heap)
    scores = np.zeros(n, np.int64)
    for d, t, f in zip(*columns):
        scores[d] += weights[t] * (10**9 * f // (1000 * f + 8 * (10 + 90)))
    every.push(scores, np.arange(n), np.zeros(n, bool))
    assert heap.score.tolist() == every.score.tolist() and heap.id.tolist() == every.id.tolist()
    assert len(shard.open) < 0.5 * len(shard.last)


def test_blocks_round_trip():
    for docs, tf in (([0], [1]), ([3, 400, 70_000], [1, 300, 70_000]), (range(0, 5000, 40), range(1, 126))):
        docs, tf = np.array(docs), np.array(tf)
        data = b"pad" + _packed(docs, tf)
        a, b = _unpacked(data, 3, len(data))
        assert a.tolist() == docs.tolist() and b.tolist() == tf.tolist()
