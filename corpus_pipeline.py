"""The corpus pipeline: five stages over documents, each on what the one before it kept.

Toxic documents go; of each group of near copies (similarity 0.8 on five-word shingles) the one
with the smallest doc_id stays; passages of 50 words and more that an earlier document also holds
are cut out; documents with a benchmark item go; what is left is encoded by byte-level BPE. A
document without a finding passes every stage as it is.

Defined cases, for all stages: a null text counts as an empty one and stays null where the row stays;
texts without words are copies of each other, of which one stays; of copies and near copies the row with
the smallest doc_id stays, a null doc_id only where no other is, of rows that share a doc_id the one with
the least hash of its text, of equal rows one; rows that share a doc_id do not cut passages out of each
other, and a null doc_id cuts none and loses none; an empty table passes through every stage empty; a
null in any other column stays as it is; further columns, whatever their names, are passed on by all
stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runweave.llm import byte_bpe, decontamination, simhash, substring, toxicity
from runweave.llm.common import small_batches, written


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from the labelled rows of its input."""
    small_batches(spark)
    return toxicity.accepted(docs, toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one also holds."""
    small_batches(spark)
    return substring.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", ordinary),
    ("SimHash near-dedup", distinct),
    ("substring dedup", unrepeated),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", encoded),
]

#: SQL cannot express the model, the fingerprints or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline")
    return docs
