"""Documents to packed sequences: quality rules, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.decontaminate import without_benchmark
from shelfwise.llm.line_dedup import drop_boilerplate_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.packing import pack
from shelfwise.llm.quality_rules import quality_rules
from shelfwise.llm.shared import settled, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs).filter("quality.kept").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the boilerplate lines of its source; ``n_chars`` follows the text."""
    cleaned = drop_boilerplate_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id.

    Rows that repeat an id, or have none, are told apart by id and text: each such text is a
    document of its own. Of rows equal in both one stays, the first by its other columns; texts
    without a word are linked with nothing and all stay.
    """
    alike = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id")
    often = settled(alike)
    if often.isEmpty():
        dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(COLUMNS)
    marked = often.select(F.col("doc_id").alias("often"), F.lit(True).alias("repeated"))
    told = docs.join(marked, docs["doc_id"].eqNullSafe(marked["often"]), "left")
    key = F.when(F.col("repeated"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    told = settled(told.withColumn("key", key).select("key", "repeated", *COLUMNS))
    dropped = near_duplicates(told, id="key").filter("not kept").select("key").distinct()
    kept = settled(told.join(dropped, "key", "left_anti"))
    worded = F.coalesce(F.col("repeated") & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    equal = kept.filter(worded).groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.filter(~worded).select(COLUMNS).unionByName(equal)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    return pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", keep_first),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_documents),
]

# near-duplicate classes and edit distances within a band have no statement; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to shared storage and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    place = shared_folder(spark)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{name}")
    return docs
