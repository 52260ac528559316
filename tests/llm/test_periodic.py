"""Periodic runs against a comparison of all periods, and odd input."""

import random

import numpy as np

from shelfwise.llm.blocks import mixed
from shelfwise.llm.periodic import _Windows, find_runs, periodic_runs, repeated_tail, run_digest, synchronising_set
from pyspark.sql import functions as F


def plain_runs(words, shortest=0):
    """(start, end, period) by walking every period that fits four times."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(4 * q, shortest):
                seen.setdefault((start, i + q), q)
    return sorted((s, e, q) for (s, e), q in seen.items())


def repetitive(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n:
            a = rng.randrange(n)
            m = rng.randrange(1, n - a + 1)
            unit = words[a : a + rng.randrange(1, m // rng.choice([1, 4, 5, 8]) + 2)]
            words[a : a + m] = [unit[i % len(unit)] for i in range(m)]
    return words


def test_find_runs():
    rng = random.Random(5)
    for _ in range(300):
        texts = [repetitive(rng, rng.choice([0, 1, 7, 40, 200, 700]), rng.choice([1, 2, 3, 60])) for _ in range(4)]
        flat, bounds, want = [], [0], []
        for d, words in enumerate(texts):
            want += [(s + len(flat), e + len(flat), q) for s, e, q in plain_runs(words)]
            flat += [*words, 10**6 + d]
            bounds.append(len(flat))
        got = find_runs(mixed(np.array(flat, np.uint64)), np.array(bounds))
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_synchronising_set_is_consistent_and_dense():
    rng = np.random.default_rng(3)
    values = mixed(rng.integers(0, 40, 600, dtype=np.uint64))
    values = np.concatenate([values, values[100:400], mixed(rng.integers(0, 40, 200, dtype=np.uint64))])
    tau = 16
    chosen = set(synchronising_set(_Windows(values), tau, np.zeros(len(values), bool)).tolist())
    assert all((i in chosen) == (i + 500 in chosen) for i in range(100, 400 - 2 * tau))
    assert all(chosen & set(range(i, i + tau)) for i in range(len(values) - 3 * tau))
    assert len(chosen) < len(values) / 2


def test_long_and_odd_texts(spark):
    unit = " ".join(f"w{i}" for i in range(1000))
    rows = [(1, None, 0), (2, "", 0), (None, "a " * 9, 0), (3, "\u00e9 x\t" * 8, 0), (3, "a b c", 0), (4, f"{unit} " * 60, 0), (5, "z " * 300_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()}
    assert got[1, 0] == got[2, 0] == ([], "")
    assert got[None, 9] == ([(0, 9, 1)], "a") and got[3, 16] == ([(0, 16, 2)], "\u00e9 x") and got[3, 3] == ([], "a b c")
    assert got[4, 60_000] == ([(0, 60_000, 1000)], unit) and got[5, 300_000] == ([(0, 300_000, 1)], "z")
    assert periodic_runs(docs.limit(0)).count() == 0
    digest = {r["doc_id"]: r for r in run_digest(periodic_runs(docs.filter("doc_id != 3"))).collect()}
    assert (digest[4]["length"], digest[4]["exponent_milli"], digest[1]["start"], digest[1]["n_runs"]) == (60_000, 60_000, None, 0)


def test_neighbouring_runs_keep_their_first_period(spark):
    text = "q " + "a b " * 5 + "c c c c c c d " + "x y z " * 3
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 10, 2), (11, 6, 1)]
    assert row["collapsed"] == "q a b c d x y z x y z x y z"


def test_planted_tails(spark):
    import zlib

    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(200)] + [(None, "a b"), (7, None)], "doc_id long, text string")
    for row in docs.select("doc_id", "text", repeated_tail(F.col("doc_id"), F.col("text")).alias("t")).collect():
        want = row["text"]
        if row["doc_id"] is not None and want and (h := zlib.crc32(str(row["doc_id"]).encode())) % 10 == 0:
            a, g = h // 10 % 50, h // 10
            p = 1 + (50 - a) // (3 + g % 8)
            want = " ".join(words[i if i < a else a + (i - a) % p] for i in range(50))
        assert row["t"] == want
