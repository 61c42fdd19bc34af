"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of an unsure one, go: null, empty and letterless texts among them.

    Repeated rows go or stay together.
    """
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines go, and documents that this leaves without words; ``n_chars`` is of what is left.

    Of equal lines the one of the smallest id, then place, stays.  Texts that were null or
    blank before stay.
    """
    got = line_dedup.dedup_lines(docs, emptied=False)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id; null and blank texts have no class and stay."""
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and blank texts stay, and all if the benchmark is empty."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, as pieces in sequences of 1024 tokens; a null text is the end token alone, and repeated rows are packed each."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL cannot express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
