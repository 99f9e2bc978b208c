"""The corpus pipeline: documents to packed sequences, in five stages over all that each predecessor kept.

Defined cases, stage by stage: a null text counts as empty; the classifier keeps or rejects it like any other text without
votes, exact dedup keeps one such document, near dedup links it with nothing, suffix dedup leaves it null, and packing makes it
an end id. Texts of any length are worked on whole. Null ids take part and lose to others; rows with equal ids are separate
documents. Of equal rows exact dedup keeps one. An empty table gives empty results, and columns of any name pass through all
stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import exact_dedup, neardup, packing, quality, suffixes
from lodestream.llm.common import delete_paths, discard, materialize, read_table, scratch_made


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the document with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs, keep="smallest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, similarity of 0.8), the document with the smallest id stays."""
    return neardup.drop_near_duplicates(docs, threshold=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start at several places go; n_chars follows the text."""
    kept = suffixes.remove_repeats(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kept.schema["n_chars"].dataType)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing_stage),
]
#: SQL can't express the fitted classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; then what it and its predecessor wrote is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_made() as made:
            result = stage(spark, docs, sf_dir)
        before, docs = docs, materialize(result, name.replace(" ", "-"))
        delete_paths(spark, made)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
