"""Corpus pipeline over ``documents``: quality rules, near-duplicates, personal data,
mixing, tokens. Each stage works on all that the one before kept and returns the columns
of ``documents``; the last returns the tokens.

Null or empty texts fail the quality rules; repeated rows leave the near-duplicate stage
once (and may come back as repeats of the mix); an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopflow.llm import bpe, mixing, pii, quality_lines, simhash_pivots
from shopflow.llm.common import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their hosts' boilerplate lines."""
    return quality_lines.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, at most 2 differing bits)."""
    return simhash_pivots.keep_one(docs, 3, 2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data),
          ("mixture", mixture), ("tokens", tokens)]

# Fingerprints, merges and the shuffle's hashes are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
