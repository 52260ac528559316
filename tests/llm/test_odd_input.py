"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm.decontaminate import benchmark_passages, without_benchmark
from shelfwise.llm.line_dedup import drop_boilerplate_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.packing import pack, sequences
from shelfwise.llm.phrase_dedup import remove_recurring_phrases
from shelfwise.llm.pii import personal_data, sanitised, span_digest
from shelfwise.llm.quality_classifier import quality_scores
from shelfwise.llm.quality_rules import quality_rules
from shelfwise.llm.suffix_dedup import remove_repeated_bytes
from shelfwise.llm.warc import archived_pages

CLASHES = ["id", "key", "bucket", "kept", "quality", "n", "t1", "part", "host", "lines", "rank", "length", "label", "found", "text.old"]
PASSAGE = " ".join(f"word{i}" for i in range(40))


def table(spark, rows):
    """documents (doc_id, text, lang, source, n_chars) and a null column for each clashing name."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40_000))
    rows = [
        (1, PASSAGE, "en", "s", 1), (1, PASSAGE, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0),
        (None, PASSAGE, "en", "s", 1), (4, " \n\t ", "en", None, 4), (5, long, "en", "s", 1), (6, PASSAGE + " é😀 end", "en", "s", 1),
        (-7, PASSAGE, "en", "s", 1), (8, "a", "en", "s", 1),
    ]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "short"), (None, "z" * 50)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, None), (3, 0, 0), (99, 1, 0), (8, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def test_near_duplicates(odd, empty):
    got = near_duplicates(odd)
    assert got.count() == 10
    found = by_id(got, "component_id", "kept")
    assert found[1] == found[6] == (-7, False) and found[-7] == (-7, True)
    assert all(found[i] == (i, True) for i in (2, 3, 4, 5, 8))
    assert [tuple(r)[2:] for r in got.filter("doc_id is null").collect()] == [(None, True)]
    assert near_duplicates(empty).count() == 0


def test_lines(odd, empty):
    got = drop_boilerplate_lines(odd, least_pages=2, ratio=0.3)
    assert got.count() == 10 and set(odd.columns) <= set(got.columns)
    found = by_id(got, "text", "lines_total", "lines_removed")
    assert found[1] == ("", 1, 1) and found[2] == (None, 0, 0) and found[3] == ("", 1, 0) and found[6][2] == 0
    assert drop_boilerplate_lines(empty).count() == 0


def test_rules(odd, empty):
    got = quality_rules(odd)
    assert got.count() == 10 and set(got.columns) == set(odd.columns)
    assert by_id(got.select("doc_id", "quality.base_failed"), "base_failed")[2] == (True,)
    assert quality_rules(empty).count() == 0


def test_personal_data(odd, empty):
    got = span_digest(personal_data(odd))
    assert got.count() == 10 and by_id(got, "n_email", "spans")[2] == (0, "")
    assert span_digest(personal_data(empty)).count() == 0
    assert personal_data(odd).select(sanitised(F.col("text"), F.col("spans")).alias("s")).filter("s is null").count() == 0


def test_shared_passages(odd, empty):
    words = by_id(remove_recurring_phrases(odd), "n_words", "n_removed")
    assert words[-7] == (40, 0) and words[1] == (40, 40) and words[6] == (42, 40) and words[2] == (0, 0) and words[5][1] == 0
    assert remove_recurring_phrases(odd).filter("doc_id is null").first()["n_removed"] == 0
    size = len(PASSAGE)
    cut = by_id(remove_repeated_bytes(odd), "n_bytes", "n_removed", "n_spans")
    assert cut[-7] == (size, 0, 0) and cut[1] == (size, size, 1) and cut[6] == (size + 11, size, 1) and cut[4] == (4, 0, 0)
    assert remove_repeated_bytes(odd).count() == 10 == remove_recurring_phrases(odd).count()
    assert remove_repeated_bytes(empty).count() == 0 == remove_recurring_phrases(empty).count()


def test_packing(odd, empty):
    got = pack(odd, with_ids=True)
    assert got.filter("doc_id is null").count() == 1 and got.filter("doc_id = 2").first()["length"] == 1
    assert got.filter("doc_id = 1").count() == 2
    whole = sequences(got).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(r["length"] for r in got.collect())
    assert max(len(r["ids"]) // 4 for r in whole) <= 1024
    assert pack(empty).count() == 0


def test_classifier(odd, empty, labels):
    got = quality_scores(odd, labels)
    assert got.count() == 10 and got.filter("score is null or score < 0 or score > 1 or predicted is null or held_out is null").count() == 0
    assert quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_benchmark(odd, empty, items):
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in benchmark_passages(odd, items).collect())
    assert got == sorted((str(i), 1) for i in (1, 1, None, 6, -7))
    assert sorted(r["doc_id"] for r in without_benchmark(odd, items).collect()) == [2, 3, 4, 5, 8]
    assert without_benchmark(odd, items).columns == odd.columns
    assert benchmark_passages(empty, items).count() == 0 == benchmark_passages(odd, items.limit(0)).count()


def test_pages(spark, folder):
    page = "<p>" + "x" * 1000 + "</p>"
    rows = [(1, "http://a/\n1", page, 0), (2, None, page, 0), (2, None, page, 0), (None, "u", page, 0), (3, "u", None, 0), (4, "u", "small", 0), (5, "u", "small", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in archived_pages(pages).collect())
    assert got == sorted([
        ("1", "revisit", "2", 1007), ("2", "response", "None", 1007), ("2", "response", "None", 1007), ("None", "revisit", "2", 1007),
        ("3", "response", "None", 0), ("4", "response", "None", 5), ("5", "response", "None", 5),
    ])
    assert archived_pages(pages.limit(0)).count() == 0
