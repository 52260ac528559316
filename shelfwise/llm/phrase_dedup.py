"""Substring dedup over words: recurring phrases found by Aho-Corasick automata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.anchors import WordUnits, remove_shared
from shelfwise.llm.quality_rules import SPACES

WIDTH = 13
GRAM = 4
PHRASES = 200_000


def located_phrases(stretches: list[bytes], lowest: np.ndarray, width: int) -> list[np.ndarray]:
    """Smallest id of each window of ``width`` words of every stretch.

    Phrases are confirmed word by word first: those in one stretch only need no search, their
    smallest id is the stretch's. The others are compiled, as sequences of word numbers, into
    automata of at most ``PHRASES`` phrases, and all stretches stream through each.
    """
    import ahocorasick

    numbers: dict[bytes, int] = {}
    texts = [tuple(numbers.setdefault(w, len(numbers)) for w in s.split(b" ")) for s in stretches]
    once: dict[tuple, int] = {}
    phrases: dict[tuple, int] = {}
    for text, me in zip(texts, lowest.tolist()):
        for i in range(len(text) - width + 1):
            phrase = text[i : i + width]
            before = once.setdefault(phrase, me)
            if before != me:
                phrases[phrase] = min(before, me, phrases.get(phrase, me))
    out = [np.full(len(t) - width + 1, me, np.int64) for t, me in zip(texts, lowest.tolist())]
    every = list(phrases.items())
    for start in range(0, len(every), PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        chunk = every[start : start + PHRASES]
        for k, (phrase, _) in enumerate(chunk):
            automaton.add_word(phrase, k)
        automaton.make_automaton()
        for text, ids in zip(texts, out):
            for end, k in automaton.iter(text):
                ids[end - width + 1] = min(ids[end - width + 1], chunk[k][1])
    return out


def remove_recurring_phrases(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans, spans): words covered by a phrase that a smaller id holds too.

    A phrase is ``width`` consecutive words of one document; it is compared unchanged and judged on
    the input. ``spans`` are the removed runs in words, so the kept text is every other word.

    Defined cases: a null or wordless text has no words and nothing removed; a row without id
    neither loses words nor makes others lose any; rows that repeat an id do not count as smaller
    than each other; a text under ``width`` words is whole; other columns are ignored.
    """
    words = F.array_remove(F.split("text", SPACES), "")
    units = WordUnits(width, min(GRAM, width))
    whole = F.sha2(F.array_join(words, " ").cast("binary"), 256)
    found = remove_shared(docs, units, located_phrases, id=id, text=text, count=F.size(words), whole=whole)
    return found.select(F.col("id").alias(id), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", "n_spans", "spans")
