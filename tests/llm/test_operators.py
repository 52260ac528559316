"""Operators against plain versions, exact round trips and held-out accuracy."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import pii, quality_classifier, suffix_dedup, warc
from shelfwise.llm.components import components
from shelfwise.llm.decontaminate import benchmark_passages
from shelfwise.llm.line_dedup import drop_boilerplate_lines, host_of
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.packing import default_vocabulary, load_encoder, plan_bins
from shelfwise.llm.phrase_dedup import located_phrases, remove_recurring_phrases
from shelfwise.llm.pii import personal_data, sanitised, span_digest
from shelfwise.llm.quality_rules import quality_rules
from shelfwise.llm.queries import QUERIES
from shelfwise.llm.suffix_dedup import remove_repeated_bytes
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


def corpus(seed, n, vocabulary=60):
    """Random texts, near copies of a few, and passages dealt among them; a third stem from one text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary * 20)}"
    seeds = [[word() for _ in range(rng.choice([4, 30, 60]))] for _ in range(6)]
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        words = list(seeds[0] if i % 3 == 0 else rng.choice(seeds) if rng.random() < 0.5 else [word() for _ in range(40)])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words[rng.randrange(len(words)) : 0] = passage
        out.append((i * 7 % n, " ".join(words)))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    docs = corpus(1, 240)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=width, percent=percent).collect()
    want = plain.classes(docs, width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    top = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert got == top


@pytest.mark.parametrize("rows", [1 << 20, 50, 7])
def test_transform(monkeypatch, rows):
    """The built rows are all suffixes in order, with their true common prefixes, whatever the file size."""
    monkeypatch.setattr(suffix_dedup, "FILE_ROWS", rows)
    rng = random.Random(rows)
    for _ in range(30):
        width = rng.choice([3, 5, 8])
        texts = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(width, 3 * width))) for _ in range(30)})
        ids = np.array([rng.randrange(50) for _ in texts])
        least = {}
        for t, i in zip(texts, ids.tolist()):
            for k in range(len(t) - width + 1):
                least[t[k : k + width]] = min(i, least.get(t[k : k + width], i))
        for t, found in zip(texts, suffix_dedup.smallest_ids(texts, ids, width)):
            assert found.tolist() == [least[t[k : k + width]] for k in range(len(t) - width + 1)]


def test_transform_order(folder):
    texts = [b"banana", b"ananas", b"nab", b"banana"]
    built = suffix_dedup.Transform(texts, folder)
    (symbols, shared, length, text), want = built.rows(0), sorted((t[k:], i) for i, t in enumerate(texts) for k in range(len(t) + 1))
    assert [(texts[t][len(texts[t]) - n :], t) for n, t in zip(length, text)] == want
    common = [0] + [next((k for k in range(len(a)) if a[k] != b[k : k + 1][:1] and a[k : k + 1] != b[k : k + 1]), len(a)) for (a, _), (b, _) in zip(want, want[1:])]
    assert shared.tolist() == common


def test_located_phrases():
    got = located_phrases([b"a b c d", b"x b c d e", b"q r s"], np.array([5, 3, 9]), 3)
    assert [g.tolist() for g in got] == [[5, 3], [3, 3, 3], [9]]


@pytest.mark.parametrize("partitions", ["4", "13"])
def test_shared_passages(spark, partitions):
    docs = corpus(2, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        words = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_recurring_phrases(df).collect()}
        cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in remove_repeated_bytes(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert words == plain.without_shared(docs, 13, bytes.split, b" ".join)
    assert cut == plain.without_shared(docs, 50, lambda x: x, b"".join)


def test_plan_bins():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([10, 64, 1024])
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 7, 10**9]) for _ in range(rng.randint(1, 40))}
        placed = {}
        for lengths, times in plan_bins(counts, capacity):
            assert sum(lengths) <= capacity and times > 0 and sum(3 * k > capacity for k in lengths) <= 2
            for k in lengths:
                placed[k] = placed.get(k, 0) + times
        assert placed == counts


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = QUERIES["op7_best_fit_packing"](spark, FOLDER).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = got[got.doc_id == r["doc_id"]].sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.length.sum() == len(ids)
        assert pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]] and (pieces.length[1:] == 1024).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.02 + 1


def test_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = load_encoder(default_vocabulary())
    end = "<|endoftext|>"
    for text in (end, f"one{end}two", f"one {end} two\n{end}{end}", f" {end}", "<|endoftext|", f"<{end}>", f"é{end}\n\n", "<|ENDOFTEXT|>", ""):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode(f"a{end}").tolist()[-1] == 50256


def test_rules(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(-1, "a b c a b c\n\na b c a b c\nx\x0by | # x"), (-2, "one"), (-3, "b b b b b")], "doc_id long, text string")
    judged = quality_rules(docs.select("doc_id", "text").unionByName(extra))
    for r in judged.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == plain.rule_counts(r["text"])
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_tell_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules(docs).select("doc_id", "quality.kept", "quality.base_failed").join(labels, "doc_id")
    assert judged.filter("quality = 0 and kept").count() == 0
    assert judged.filter("quality = 1 and not kept and not base_failed").count() == 0


def test_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_classifier"](spark, folder)
    held = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    right, all_ = held.filter("predicted = quality").count(), held.count()
    assert all_ > 50 and right >= 0.95 * all_
    assert {r["doc_id"] for r in got.filter("held_out").collect()} == {r["doc_id"] for r in got.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_novelty_counts_every_string():
    texts = [bytes([c]) * 4000 for c in range(32, 127)] + [b"ha " * 900, b"buy " * 900, b"- " * 900, b"*-" * 900]
    texts += [b"", b"short", b"eight by", b"nine byte", b"aaaaaaaaaaaa", random.Random(5).randbytes(3000), b"tail"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality_classifier._novelty(np.frombuffer(b"".join(texts), np.uint8), offsets)
    strings = [[t[k : k + 8] for k in range(len(t) - 7)] for t in texts]
    assert got.tolist() == [len(set(s)) / len(s) if s else 1.0 for s in strings]


def test_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["a@b.c_x@y.zz q@r.st.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111112",
           "+1 (222) 333-4444 +12+345678901234567 +1(2", "é😀 a@b.co 😀1.2.3.4", "a" * 30000 + "@x.y@z.w", "1" * 30000, "a.b" * 9000 + "@" + "c.d" * 9000]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id long, text string"))
    found = personal_data(docs)
    text = dict(docs.collect())
    for r in span_digest(found).collect():
        assert r["base_sha256"] == hashlib.sha256(plain.identifiers(text[r["doc_id"]]).encode()).hexdigest()
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_disclosing_terms(spark):
    """A term that stands with one identifier only goes; one that others use too stays; copies of one sentence prove nothing."""
    rows = [f"note {i}: hello wilma of bedrock, w.f@rock.org, on day x{i}" for i in range(5)]
    rows += [f"hello there {i}, nothing to see" for i in range(40)] + ["the same barney, b.r@rock.org"] * 6
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r["s"] for r in personal_data(docs).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert "wilma" not in out[0] and "bedrock" not in out[0] and "[EMAIL]" in out[0] and "hello" in out[0]
    assert out[5] == rows[5] and out[-1] == "the same barney, [EMAIL]"


def test_disclosing_terms_of_whole_texts(spark):
    """Two texts are enough, also at a text's edge or far from the identifier; copies count once on both sides."""
    far = "and so on " * 30
    rows = [f"Wilma a@b.org wrote {far} from Bedrock {x}" for x in ("red", "blue")] + ["barney is at c@d.org"] * 9
    rows += [f"hello there {i}, wrote {far} and from is at" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = [r["s"] for r in personal_data(docs).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("s")).orderBy("doc_id").collect()]
    assert out[:2] == [f"[TERM] [EMAIL] wrote {far} from [TERM] {x}" for x in ("red", "blue")]
    assert out[2] == "barney is at [EMAIL]" and out[11:] == rows[11:]


def test_benchmark_edits(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [sentence(30) for _ in range(20)]

    def edited(text, edits):
        chars = list(text)
        for _ in range(edits):
            k = rng.randrange(len(chars))
            chars[k : k + rng.randint(0, 1)] = [rng.choice("xyz")] if rng.random() < 0.7 else []
        return "".join(chars)

    docs = [(i, sentence(200) + ". " + edited(items[i], 4).upper() + "! " + sentence(200)) for i in range(20)] + [(100 + i, sentence(400)) for i in range(40)]
    query = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for chars in (10**6, 500):
        got = benchmark_passages(frame, query, block_chars=chars).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(20)]
    text = dict(docs)
    for r in got:
        part = text[r["doc_id"]][r["start"] : r["end"]].lower()
        assert len(part) <= len(items[r["item_id"]]) + 20 and set(part.split()) & set(items[r["item_id"]].split())


def test_archives(spark, folder):
    """Headers decide before payloads; plain, zipped and sized members read alike."""
    warc.register(spark)
    rows = [dict(record_type=t, record_id=f"<urn:{i}>", target_uri=f"http://h{i % 3}/{i}", payload_digest=None, refers_to=None, payload_length=None, payload=b"body %d \r\n\r\n x" % i)
            for i, t in enumerate(["response", "resource", "response", "metadata"] * 5)]
    raw = [warc.record_bytes(r, "2024-01-01T00:00:00Z") for r in rows]
    kinds = {"a.warc": b"".join(raw), "b.warc.gz": b"".join(gzip.compress(r) for r in raw), "c.warc.gz": b"".join(warc.zipped_member(r, 6) for r in raw)}
    for name, data in kinds.items():
        path = f"{folder}/{name}"
        with open(path, "wb") as out:
            out.write(data)
        read = spark.read.format("warc").load(path)
        assert [(r["record_id"], bytes(r["payload"])) for r in read.collect()] == [(r["record_id"], r["payload"]) for r in rows]
        some = read.filter("record_type = 'response' and target_uri like 'http://h0%'")
        assert [r["record_id"] for r in some.collect()] == [r["record_id"] for r in rows if r["record_type"] == "response" and "h0/" in r["target_uri"]]
        assert " Filter " not in some._jdf.queryExecution().executedPlan().toString()
        touched = []
        with warc.filesystem(path)[0].open_input_file(path) as file:
            list(warc.records(file, path, lambda h: touched.append(h) or False))
        assert len(touched) == 20
    assert spark.read.format("warc").load(folder).count() == 60
    with open(f"{folder}/d.warc", "wb") as out:
        out.write(raw[0][:-20])
    with pytest.raises(Exception, match="ends early"):
        spark.read.format("warc").load(f"{folder}/d.warc").collect()


def test_host(spark):
    df = spark.createDataFrame([("http://A.example.com/x",), ("nonsense",), (None,)], "url string")
    assert [r["h"] for r in df.select(host_of(F.col("url")).alias("h")).collect()] == ["a.example.com", None, None]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x " + " " * 1_500_000 + "y\n<|endoftext|>" + "\n \n" * 100_000])
def test_ids_of_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert load_encoder(default_vocabulary())(text).tolist() == want


def test_short_boilerplate_lines(spark):
    """Short lines go by their ratio; a line on one page of a small host, and blank ones, stay."""
    pages = [(i, f"Home\nown {i}\n\n \nShare", "big") for i in range(100)] + [(200 + i, f"Home\nown {i}", "small") for i in range(3)] + [(300, "Home", "one")]
    docs = spark.createDataFrame([*pages, (400, "Rare\nx", "big"), (401, "Rare\ny", "big")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in drop_boilerplate_lines(docs).collect()}
    assert got[5] == "own 5\n\n " and got[201] == "own 1" and got[300] == "Home" and got[400] == "Rare\nx"


def test_identifiers_of_long_tables(spark):
    """A megabyte of numbers, and tens of thousands of identifiers in one text, in seconds."""
    import time

    rows = [(1, "12, " * 250_000), (2, "1.2.3.4 alpha " * 30_000), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    begun = time.monotonic()
    got = {r["doc_id"]: (r["n_ip"], r["n_card"]) for r in span_digest(personal_data(docs)).select("doc_id", "n_ip", "n_card").collect()}
    assert got == {1: (0, 0), 2: (30_000, 0), 3: (0, 0)} and time.monotonic() - begun < 120


def test_disclosure_shares(spark):
    """Shares against a plain count over texts: around an identifier or its class, and once more right beside it."""
    import math
    import re
    from collections import defaultdict

    rng = random.Random(8)
    names = [f"name{i}" for i in range(12)]
    texts = []
    for i in range(60):
        words = [rng.choice(names) if rng.random() < 0.3 else f"word{rng.randrange(40)}" for _ in range(12)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            words.insert(rng.randrange(13), f"user{rng.randrange(6)}@site{rng.randrange(3)}.org")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[0])], "doc_id long, text string")
    keyed = docs.select("text", F.xxhash64("text").alias("t1"), F.lit(0).alias("t2"))
    found = keyed.withColumn("found", pii.base_spans(F.col("text")))
    rated = pii.disclosing_terms(found, pii.terms_beside(found), generalise=0.6)
    got = {(r["entity"], r["term"]): r["share"] for r in rated.collect()}

    ne, nt, net, near = (defaultdict(set) for _ in range(4))
    for k, text in enumerate(dict.fromkeys(texts)):
        words = text.split()
        mails = [j for j, w in enumerate(words) if "@" in w]
        named = lambda j: [f"email:{words[j]}", f"email of {words[j].split('@')[1]}"]  # noqa: B023, E731
        for j in mails:
            for e in named(j):
                ne[e].add(k)
        for j, w in enumerate(words):
            if j in mails:
                for part in re.findall(r"[A-Za-z0-9]{3,}", w):
                    nt[part].add(k)
                continue
            nt[w].add(k)
            left, right = [m for m in mails if m < j][-1:], [m for m in mails if m > j][:1]
            for m in left + right:
                for e in named(m):
                    net[e, w].add(k)
                    if abs(m - j) == 1:
                        near[e, w].add(k)
    n = len(set(texts))
    want = {}
    for (e, t), held in net.items():
        if len(ne[e]) < n:
            weight = len(held) + len(near[e, t]) * min(1, math.log(n / len(nt[t])) / math.log(pii.RARE))
            share = weight / (weight + 1) * math.log(len(held) * n / (len(ne[e]) * len(nt[t]))) / math.log(n / len(ne[e]))
            if share >= 0.6:
                want[e, t] = share
    assert got.keys() == want.keys() and len(got) > 5
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
