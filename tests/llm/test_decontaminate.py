"""Benchmark passages against the edit distance of every window to every place of a document."""

import random
import string
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import decontaminate as module
from shelfwise.llm.decontaminate import EDITS, WINDOW, Normaliser, benchmark_passages


def normal(text):
    codes, _ = Normaliser()(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]))
    return "".join(map(chr, codes))


def least_edits(windows, doc):
    """Per window the least edit distance to any part of ``doc``: one row of the distance table at a time."""
    letters = np.array([[ord(c) for c in w] for w in windows])
    text = np.array([ord(c) for c in doc])
    cost = np.zeros((len(windows), len(text) + 1), int)
    columns = np.arange(len(text) + 1)
    for i in range(letters.shape[1]):
        step = cost + 1
        step[:, 1:] = np.minimum(step[:, 1:], cost[:, :-1] + (text != letters[:, i : i + 1]))
        cost = np.minimum.accumulate(step - columns, axis=1) + columns
    return cost.min(axis=1)


def plain_pairs(docs, items):
    out = set()
    for i, item in items:
        item = normal(item).strip()
        if len(item) < 8:
            continue
        size = min(len(item), WINDOW)
        windows = [item[s : s + size] for s in range(len(item) - size + 1)]
        for d, doc in docs:
            if doc and least_edits(windows, normal(doc)).min() <= size * EDITS // WINDOW:
                out.add((d, i))
    return sorted(out)


def prose(rng, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(string.ascii_lowercase[:9]) for _ in range(rng.randrange(1, 8))) + rng.choice([" ", ", ", ". ", "\n"])
    return out[:n]


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(["", "x", text[k] + "y"]) + text[k + 1 :]
    return text


@pytest.mark.parametrize("excerpt", [64, 70, 79])
def test_excerpts_at_every_offset(spark, excerpt):
    """Verbatim excerpts, and such with up to five edits, wherever they start in the item."""
    rng = random.Random(excerpt)
    item = prose(rng, 150)
    docs = []
    for offset in range(0, 150 - excerpt + 1):
        part = item[offset : offset + excerpt]
        docs.append(prose(rng, rng.choice([0, 5, 90])) + " " + edited(rng, part, offset % 7) + " " + prose(rng, rng.choice([0, 60])))
    docs = list(enumerate(docs))
    got = benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == plain_pairs(docs, [(1, item)])


def test_short_items_stand_whole(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([4, 8, 9, 12, 20, 31, 40, 63])]
    docs = []
    for k, item in items:
        for n in (0, 1, 2, 3, 4):
            docs.append(prose(rng, 40) + " " + edited(rng, item, n) + " " + prose(rng, 30))
            docs.append(edited(rng, item, n))
    docs = list(enumerate(docs))
    got = benchmark_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    pairs = sorted((r["doc_id"], r["item_id"]) for r in got.collect())
    assert pairs == plain_pairs(docs, items) and len({i for _, i in pairs}) >= 6


def test_memory_of_a_batch(monkeypatch):
    """A worker holds a block of the batch at a time, whatever the batch's size; passages keep their places."""
    rng = random.Random(5)
    item = prose(rng, 120)
    texts = ["é" * (k % 7) + "z " * 400 + (item if k % 500 == 0 else "") for k in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    shared = SimpleNamespace(value=module.compiled([(1, item)]))
    monkeypatch.setattr(module, "ALIGNED", 50, raising=False)
    tracemalloc.start()
    found = [r for b in module._searched(shared)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["doc_id"] for r in found] == list(range(0, 20_000, 500))
    assert all(abs(r["start"] - r["doc_id"] % 7 - 800) <= EDITS and abs(r["end"] - len(texts[r["doc_id"]])) <= EDITS and r["edits"] == 0 for r in found)
    assert peak < 6 * batch.nbytes
