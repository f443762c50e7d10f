"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import brown, byte_bpe, decontamination, imatch, repair, sharding, simhash, substring, suffix, toxicity
from runweave.llm.common import documents, held_out


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    docs = documents(spark, sf_dir)
    return imatch.compared(docs, imatch.band(docs))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts under class bigrams and under unigrams of the training rows."""
    return brown.scores(documents(spark, sf_dir), held_out(5))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmed hit of a benchmark item in a document."""
    return decontamination.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by law ``rows``."""
    out = sharding.shard(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the 50k byte-level ranks and decoded again."""
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of three-word shingles, linked at three differing bits or fewer."""
    rows = simhash.components_of(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.scored(docs, model)
    return score.select("doc_id", held_out(3).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as Re-Pair blocks, in ascending doc_id order, and read back."""
    table = repair.save(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return repair.digests(repair.read(table))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 words and more that an earlier document holds too, removed."""
    return substring.digests(documents(spark, sf_dir)).drop("spans")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings that an earlier document holds too, removed."""
    return suffix.digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_imatch, op2_brown, op3_decontamination, op4_sharding, op5_byte_bpe, op6_simhash, op7_toxicity, op8_repair, op9_substring, op10_suffix)
}
ORACLE_SQL: dict[str, str] = {}
