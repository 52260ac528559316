"""Rule-based quality filter: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages the collection holds; extend the table for further languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which an".split(),
    "fr": "le la les de des du et un une en que qui dans pour est pas au sur ce il plus par avec".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de que y en un una por con no para es se del al lo como su".split(),
}


@dataclass(frozen=True)
class Rule:
    """``least <= top / below <= most`` must hold; ``below`` None divides by nothing. A zero divisor counts as one."""

    name: str
    top: str
    below: str | None = None
    least: float | None = None
    most: float | None = None


BASE = (Rule("words", "n_words", least=50), Rule("repeated_words", "n_repeat_words", "n_words", most=0.5))
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2.0, most=15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.06),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("shouted_words", "n_shouted", "n_words", most=0.3),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _stop_forms() -> list[str]:
    words = sorted({w for group in STOP_WORDS.values() for w in group})
    return [form + end for w in words for form in (w, w.capitalize()) for end in ("", ",", ".")]


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more: sort the windows' hashes, keep equal neighbours, add up their reach."""
    windows = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    ordered = F.sort_array(F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0))))
    twice = lambda s: F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
    places = let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x.i)))
    reach = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3))))
    return let(places, lambda p: F.aggregate(reach(p), F.lit(0), lambda a, x: a + x))


def measures(text: Column) -> Column:
    """A struct of the counts the rules use, in one expression; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(_stop_forms()))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shouted"),
        )

    return let(F.array_remove(F.split(text, SPACES), ""), counts)


def _fails(rule: Rule, row: Column) -> Column:
    value = row[rule.top]
    divisor = F.greatest(row[rule.below], F.lit(1)) if rule.below else F.lit(1)
    bad = F.lit(False)
    if rule.least is not None:
        bad = bad | (value * F.lit(100) < divisor * F.lit(round(rule.least * 100)))
    if rule.most is not None:
        bad = bad | (value * F.lit(100) > divisor * F.lit(round(rule.most * 100)))
    return bad


def quality_rules(docs: DataFrame, *, text: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the column ``quality``: a struct of the counts, ``base_failed``, ``failed`` (rule names) and ``kept``.

    Thresholds are held as whole hundredths, so every test is one of integers. The counts need one
    pass over a row and no shuffle, whatever its neighbours are.

    Defined cases: a null or empty text has no words and fails the base; an existing column
    ``quality`` is replaced; repeated rows are judged one by one.
    """
    def flat(row: Column) -> Column:
        return F.struct(
            *[row[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_shouted")],
            row["lines"]["dup"].alias("n_dup_lines"),
            row["lines"]["all"].alias("n_lines"),
        )

    def verdict(x: Column) -> Column:
        failed = lambda some: F.array_compact(F.array(*[F.when(_fails(r, x), F.lit(r.name)) for r in some]))
        return F.struct(
            *[x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouted", "n_lines")],
            (F.size(failed(base)) > 0).alias("base_failed"),
            failed((*base, *rules)).alias("failed"),
            (F.size(failed((*base, *rules))) == 0).alias("kept"),
        )

    # one expression, each step bound once: a filter on the verdict, wherever it is pushed, counts a text once
    return docs.withColumn("quality", let(measures(F.col(f"`{text}`")), lambda row: let(flat(row), verdict)))
