"""A corpus pipeline: quality, lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows to the shared folder and
hands them to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import crf_quality, decontamination, line_dedup, near_copies, packing
from pagewright.llm.common import read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, learned from the labelled ones, gives a score of 0.3 or more."""
    field = crf_quality.learn(docs, read(spark, sf_dir, "labels"))
    return crf_quality.keep_good(docs, field, threshold=0.3).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; those that lose every word this way go."""
    kept = line_dedup.drop_lines(docs)
    changed = F.col("n_removed_lines") > 0
    count = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", count).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints of five-word shingles, then their Jaccard similarity of 0.8, link:
    the one with the least id."""
    return near_copies.keep_one(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly benchmark go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: The classifier and the fingerprints can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
