"""A training corpus from raw documents: language ID, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet in the shared folder and hands the reread table to the next.  All but the last
return the columns they were given.  SQL can't express these stages (ORACLE_SQL is
None); tests/llm holds brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import language_mixture, packing, simhash, suffix_dedup
from sluice.llm.common import small_batches, staged, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter, or an even mixture) go."""
    small_batches(spark)
    return language_mixture.keep_identified(docs, language_mixture.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are taken out."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), keep=120_000, reuse=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
