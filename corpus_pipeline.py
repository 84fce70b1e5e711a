"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents that quote a benchmark go,
secrets are replaced, and what is left is encoded.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and is the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samplewright.llm import bpe, decontam, near_dup, secrets, toxicity
from samplewright.llm.common import table, written
from samplewright.llm.quality import fold
from samplewright.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the held-out fold of the labels is not learned from."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(folds=5) != 0)
    return toxicity.scored(docs, net, keep_rows=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no item of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.without_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each document."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

# Classifier, alignment and encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
