"""Corpus pipeline: language, exact copies, near copies, test items, packing.

Each stage takes the documents that its predecessor kept and returns those it
keeps, with the columns of ``documents``; the last returns packed pieces. The
result of each stage is written as Parquet and read again.

Defined cases are those of the operators: nulls, empty and very long texts, ties,
repeated rows and empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deeptime.llm import decontaminate, exact_dedup, language_id, near_copies, packing
from deeptime.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or under even odds) go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No two documents stay that share four fifths of their five-word shingles."""
    return near_copies.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a test item's shingles go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_test_items),
    ("packing", pack),
]

#: Classifiers, fingerprints and token ids have no portable SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
