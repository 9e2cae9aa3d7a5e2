"""The corpus pipeline: documents in, packed batches out.

Every stage works on all documents its predecessor kept; between stages the documents are written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.llm import language_id, packing, simhash, spaced_seeds, token_files, toxicity
from schemalign.operators.settle import settle

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS = 4
MOST_UNLIKE_BITS = 4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; languages without a profile are kept."""
    return language_id.in_a_language(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from their labels does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs, SHINGLE_WORDS, MOST_UNLIKE_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its place: (doc_id, piece, first_token, n_tokens, bucket, padded_to, batch, slot).

    Tokens are the ids that the tokenizer makes of the whole texts.
    """
    counted = token_files.count_tokens(docs, public_tokenizers.path(TOKENIZER), keep_words=False)
    return packing.pack(counted, F.col("n_tokens"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Learned models and hashes of words are beyond SQL; tests/llm holds the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
