"""Documents on their way to a training mix: STAGES are applied in order, each to all rows its predecessor kept."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import factloom
from factloom.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from factloom.llm.store import documents, stored

# Run in place, the package is not installed on the workers; its functions travel with the job.
cloudpickle.register_pickle_by_value(factloom)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects; held-out labels teach nothing."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=toxicity.held_out())
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by n-gram similarity."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that look live replaced in the text; copied examples stay."""
    return secrets.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with the words the mix takes of it."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxic_documents", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("live_secrets", live_secrets),
    ("mixing_to_weights", mixing_to_weights),
]

# Learned scores, edit distances and Newton steps are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
