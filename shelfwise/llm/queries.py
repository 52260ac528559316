"""The registered query of each text operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import oracle
from shelfwise.llm.decontaminate import benchmark_passages
from shelfwise.llm.jaccard_tree import jaccard_join
from shelfwise.llm.line_dedup import drop_boilerplate_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.packing import pack
from shelfwise.llm.periodic import periodic_runs, repeated_tail, run_digest
from shelfwise.llm.phrase_dedup import remove_recurring_phrases
from shelfwise.llm.pii import personal_data, span_digest
from shelfwise.llm.quality_classifier import quality_scores
from shelfwise.llm.quality_rules import quality_rules
from shelfwise.llm.ranked_search import ranked_search
from shelfwise.llm.suffix_dedup import remove_repeated_bytes
from shelfwise.llm.warc import archived_pages


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), width=3, percent=85)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = drop_boilerplate_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "source", "lines_total", "lines_removed", "text")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(personal_data(_table(spark, folder, "documents")))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(_table(spark, folder, "pages"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_bytes(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_recurring_phrases(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(_table(spark, folder, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[f"quality.{c}" for c in base])


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(_table(spark, folder, "documents"), width=4, percent=85)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return run_digest(periodic_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1,
    "op2_line_dedup": op2,
    "op3_quality_classifier": op3,
    "op4_pii": op4,
    "op5_warc": op5,
    "op6_suffix_array_dedup": op6,
    "op7_best_fit_packing": op7,
    "op8_benchmark_decontamination": op8,
    "op9_substring_dedup": op9,
    "op10_quality_rules": op10,
    "op11_jaccard_join": op11,
    "op12_ranked_search": op12,
    "op13_periodic_runs": op13,
}

SQL: dict[str, str] = oracle.SQL
