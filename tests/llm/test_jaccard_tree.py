"""The n-gram Jaccard join against comparing all pairs, with trees and tasks of a few sets."""

import random

import numpy as np
import pytest

from shelfwise.llm import jaccard_tree as module
from shelfwise.llm.jaccard_tree import SignatureTree, jaccard_join, traverse
from tests.llm import plain


def corpus(seed, n):
    """Copies with edits of a few texts, a template under the threshold in a third of all, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(5000)}"
    seeds = [[word() for _ in range(k)] for k in (3, 5, 40, 90, 150)]
    template = [word() for _ in range(60)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            words = template + [word() for _ in range(rng.choice([3, 12, 25]))]
        elif i % 3 == 1:
            words = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.choice([1, 2, 4, 30, 80]))]
        out.append((i * 11 % n, " ".join(words)))
    return out


@pytest.mark.parametrize("members, shingles", [(2048, 1 << 20), (16, 6000)])
@pytest.mark.parametrize("width, percent", [(4, 85), (2, 70)])
def test_join(spark, monkeypatch, members, shingles, width, percent):
    monkeypatch.setattr(module, "MEMBERS", members)
    monkeypatch.setattr(module, "SHINGLES", shingles)
    if members == 16:
        monkeypatch.setattr(module, "LIMITS", (10, 40, 80))
    docs = corpus(width, 320)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), width=width, percent=percent).collect()}
    want = plain.classes(docs, width, percent)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(got[i][1] == len(plain.shingles(t, width)) for i, t in docs)
    assert 20 < len(set(want.values())) < len(want)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i * i % 70_001}" for i in range(60_000))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, " \n\t"), (5, long), (6, text + " end"), (-7, text.upper()), (8, "a"), (9, "a"), (10, long + " z"), (11, "p q r s t"), (11, text)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, id string, n long")
    got = jaccard_join(docs)
    assert got.count() == len(rows)
    tops = {r["doc_id"]: r["component_id"] for r in got.collect() if r["doc_id"] is not None}
    assert tops == {1: -7, 2: 2, 3: 3, 4: 4, 5: 5, 6: -7, -7: -7, 8: 8, 9: 8, 10: 5, 11: -7}
    assert [r["component_id"] for r in got.filter("doc_id is null").collect()] == [None]
    assert jaccard_join(docs.limit(0)).count() == 0


def test_traversal_prunes():
    """Unrelated sets are dropped as nodes: few pairs of sets are looked at."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, 12).astype(np.uint64)) for _ in range(400)]
    sets += [np.append(s[:-1], np.uint64(k)) for k, s in enumerate(sets[:40])]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tree = SignatureTree(module._bitmaps(np.concatenate(sets), at, module.BITS[0]), np.diff(at))
    asked = []

    def linked(i, j):
        asked.append((i, j))
        common = len(np.intersect1d(sets[i], sets[j]))
        return 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common)

    found = traverse(tree, tree, np.arange(len(sets)), np.arange(len(sets)), 80, linked)
    assert len(found) == 40 and len(asked) < 60


def test_one_component_is_not_walked_again():
    bits = np.full((600, module.BITS[0] // 64), np.uint64(3))
    sizes = np.full(600, 64 * 2)
    asked = []
    tree = SignatureTree(bits, sizes)
    found = traverse(tree, tree, np.arange(600), np.arange(600), 85, lambda i, j: asked.append(1) or True)
    assert len(found) == len(asked) == 599


def test_trees_with_the_same_members_are_one(spark):
    rows = [(1, 0, 5), (1, 0, 6), (2, 0, 6), (2, 0, 5), (3, 0, 5), (3, 0, 6), (3, 0, 7), (3, 1, 5), (3, 1, 6)]
    left = module._told_apart(spark.createDataFrame(rows, "g long, part long, id long")).collect()
    assert sorted((r["g"], r["part"], r["id"]) for r in left) == [(1, 0, 5), (1, 0, 6), (3, 0, 5), (3, 0, 6), (3, 0, 7)]


@pytest.mark.parametrize("percent", [85, 30])
def test_cells_hold_every_pair_of_sizes(spark, percent):
    """Members that sizes let link meet in a cell; a cluster is not sent whole to all its parts, nor a cell of one component."""
    sizes = list(enumerate([*range(1, 40), 63, 64, 65, 1000, 1204, 1205, 5000]))
    open_ = spark.createDataFrame([(1, i, i, 0) for i, _ in sizes] + [(2, 0, 0, 0), (2, 45, 45, 0)], "g long, id long, component_id long, main long")
    rows = module._celled(open_, spark.createDataFrame(sizes, "id long, n long"), percent).collect()
    cells = {i: {r["cell"] for r in rows if (r["g"], r["id"]) == (1, i)} for i, _ in sizes}
    for i, x in sizes:
        assert all(cells[i] & cells[j] for j, y in sizes if x < y and 100 * x >= percent * y)
    assert all(r["outside"] == (r["id"] != 0) for r in rows) and not any(r["g"] == 2 for r in rows)
    assert percent < 50 or sum(map(len, cells.values())) < 1.5 * len(sizes)


def test_trees_with_many_common_members_are_one(spark, monkeypatch):
    rows = [(1, 0, 5, 9), (1, 0, 6, 9), (2, 0, 6, 9), (2, 0, 7, 9), (3, 0, 8, 4), (3, 0, 9, 4), (4, 1, 5, 9), (4, 1, 6, 9)]
    sized = spark.createDataFrame(rows, "g long, part long, id long, low long")
    got = lambda: sorted((r["g"], r["part"], r["id"]) for r in module._merged(sized).collect())
    assert got() == [(4, -1, 8), (4, -1, 9), (4, 1, 5), (4, 1, 6), (9, -1, 5), (9, -1, 6), (9, -1, 7)]
    monkeypatch.setattr(module, "MEMBERS", 2)
    assert got() == [(1, 0, 5), (1, 0, 6), (2, 0, 6), (2, 0, 7), (4, -1, 8), (4, -1, 9), (4, 1, 5), (4, 1, 6)]


def test_members_no_proposal_joined_with_a_failed_one_are_not_open(spark, monkeypatch):
    """Forests: one with a failed pair, one without, one of a failed pair alone; and a group in several trees."""
    pairs = [(1, 2, 1, 2), (1, 2, 2, 3), (2, 2, 4, 5), (2, 2, 5, 6), (3, 1, 7, 8)]
    proposed = spark.createDataFrame(pairs, "forest long, pairs long, a long, b long")
    links = spark.createDataFrame([(1, 2), (4, 5), (5, 6)], "a long, b long")
    found = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 4), (6, 4)], "id long, component_id long")
    members = spark.createDataFrame([(0, i, 9, 1) for i in range(1, 10)], "g long, id long, size long, low long")
    got = lambda: {r["id"]: r["component_id"] for r in module._still_open(members, proposed, links, found).collect()}
    assert got() == {1: 1, 2: 1, 3: 3}
    monkeypatch.setattr(module, "MEMBERS", 8)
    assert got() == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}


def test_a_shared_passage_moves_few_sets(spark, monkeypatch):
    """Texts that share a passage, some nearly alike: bitmaps go to few trees, and no whole set to a cluster."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(60)] for _ in range(40)]
    texts += [words[:-9] + [word() for _ in range(11)] for words in texts[:3]]
    docs = [(i, " ".join(words)) for i, words in enumerate(texts)]
    seen = {}
    for name in ("_still_open", "_told_apart"):
        plainly = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=plainly, name=name: seen.setdefault(name, f(*a)))
    monkeypatch.setattr(module, "BUCKETS", 1)  # the passage's shingles come as early as any
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain.classes(docs, 4, 85) == {i: i for i in got}
    assert seen["_still_open"].count() == 0 and seen["_told_apart"].count() < 2.5 * len(docs)
