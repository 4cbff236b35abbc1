"""Training-data pipeline: each stage is written as Parquet and reread as the next one's documents.

Quality rules clean lines and reject documents; of each near-duplicate group the
smallest id stays; strings of 50 bytes that repeat across documents are removed;
sources are mixed to their target weights, so rows of one id may repeat; the
texts are encoded.  Columns of ``documents`` go through all stages but the last,
with ``text`` and ``n_chars`` as the stages leave them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gyrespark.llm import bpe, mixing, quality, simhash, suffixes
from gyrespark.llm.common import load
from gyrespark.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.op3(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("source mixing", source_mixing),
    ("BPE encoding", encoding),
]
# Hashes of other libraries, suffix sorting and BPE merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; their tables lie in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
