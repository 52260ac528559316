"""The pipeline's stages against plain versions on a small corpus."""

import random

import corpus_pipeline
from shelfwise.llm.quality_rules import quality_rules
from tests.llm import plain


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    clean = lambda n: " ".join(rng.choice(["the", "of", "and"]) if k % 4 == 0 else f"word{rng.randrange(9000)}" for k in range(n))
    foot = "This line stands on every page of the site."
    leak = clean(60)
    texts = [clean(80) for _ in range(30)]
    texts += [texts[0], texts[1] + " and one more word", "too short", "### " * 80, clean(60) + " " + leak + " " + clean(60), None, ""]
    rows = [(i, t if t is None else t + "\n" + foot, "en", "a" if i % 2 else "b", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        seen[name] = {r["doc_id"]: r for r in out.collect()}
    good = {r["doc_id"] for r in quality_rules(docs).filter("quality.kept").collect()}
    assert set(seen["quality_rules"]) == good == set(range(32)) | {34}
    lines = seen["line_dedup"]
    assert set(lines) == good and all(foot not in r["text"] and r["n_chars"] == len(r["text"]) for r in lines.values())
    classes = plain.classes([(i, r["text"]) for i, r in lines.items()], 5, 80)
    assert set(seen["minhash_near_dedup"]) == {i for i, c in classes.items() if i == c} == set(range(30)) | {34}
    assert set(seen["benchmark_decontamination"]) == set(range(30))

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(range(30)) and len(packed) == 30
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"
    ]


def test_rows_that_repeat_an_id(spark):
    """Texts decide: of a class one row stays, and no text is lost because another has its id."""
    rng = random.Random(7)
    text = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (2, text[2]), (2, text[2]), (3, text[1] + " more"), (None, text[3]), (None, text[3]), (None, text[4]),
            (4, text[0]), (5, ""), (5, ""), (6, None), (7, text[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_first(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(left) == 9 and left.count((5, "")) == 2 and (6, None) in left and (7, text[5]) in left
    assert sum(t in (text[1], text[1] + " more") for _, t in left) == 1
    for k in (0, 2, 3, 4):
        assert sum(t == text[k] for _, t in left) == 1


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
