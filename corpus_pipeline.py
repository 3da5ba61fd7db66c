"""A training-data pipeline over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credograph.llm import decontamination, jaccard, language, packing, queries as q, secret_scan
from credograph.llm.shared import written

#: SQL can express neither the mixture inference nor the packing.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language."""
    return language.accept(docs, language.train(docs.filter(q.fold(4) != 2)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares most of its five-word shingles."""
    return jaccard.keep_one(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that repeat too much of the benchmark, and without the 13 words and more
    that others share with it; ``n_chars`` of the new text."""
    return decontamination.clean(docs, q.table(spark, sf_dir, "benchmark"), max_span=12, length_col="n_chars")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets masked in the texts, and ``n_chars`` of the new text."""
    return secret_scan.redact(docs, length_col="n_chars", parts=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence and offset."""
    return packing.pack(docs, q.tokenizer_path())


STAGES = [("language", language_stage), ("near-duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
