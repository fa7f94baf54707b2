"""A corpus pipeline of five stages, each one of the operators in siltstone.llm.

Each stage gets what its predecessor kept and returns the columns of documents (the last one:
pieces).  Nulls, empty tables and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.bm25_packing import pack_documents
from siltstone.llm.cnn_toxicity import drop_toxic
from siltstone.llm.common import discard, materialize, table
from siltstone.llm.exact_lsm import drop_copies
from siltstone.llm.kn_quality import drop_low
from siltstone.llm.tensor_minhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high for their language."""
    return drop_low(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below their language's threshold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, that with the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the one with the smallest id."""
    return drop_near_copies(docs, threshold=(80, 100))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # nothing reads it any more
        before = docs
    return docs
