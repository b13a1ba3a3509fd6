"""The corpus pipeline: quality rules, near copies, decontamination, secrets, packing.

Each stage takes what the one before it kept. Null rows and columns follow the operators' rules:
a document without words fails the base quality rules; of documents without an id in one class of
near copies one stays; secrets are replaced in the text, and n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, packing, quality, secrets, similar
from corvane.llm.common import keep, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: a similarity of 0.8 or more in 5-word shingles, SimHash before exact sets."""
    return similar.first_of_near(docs, size=5, least=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 1024."""
    return packing.pack(docs, length=1024)


STAGES = [("quality rules", good), ("near copies", single), ("decontamination", clean), ("secrets", redacted), ("packing", packed)]

#: Exact binomial thresholds, XXH64, compression and tokenizing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
