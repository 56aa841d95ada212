"""Corpus pipeline: language ID, near-dedup, substring dedup, mixing, and encoding of documents.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.
SQL can't express any of the stages' models, so ORACLE_SQL is None; tests/llm/test_pipeline.py
compares run() with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqframe.llm import stages
from seqframe.llm.util import materialise, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_language(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As simhash_dedup, with links of texts of Jaccard similarity 0.8 or more besides those of few bits."""
    return stages.one_of_each_group(docs, least_jaccard=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
        if i:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
