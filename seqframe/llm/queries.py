"""One query for each operator of this subpackage, over whole tables, and their SQL where there is one.

SQL over whole tables exists for the base columns of the licence scan alone, which leaves out the
labels and scores of the automaton; so no query here has any. tests/llm compares each of them
with a brute-force version, the tokenizer libraries, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import ann, iblt, language, licenses, mixing, pieces, quality, simhash, sstable, substring


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, max_distance=4)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_labels(licenses.scan_licences(_read(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(~quality.held_out(4, 2)))
    found = language.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", quality.held_out(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_read(spark, sf_dir, "documents"))


def op8_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, report = mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), keep="q1t0")
    top = F.array_max("p")

    def told(what: str) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for k, v in report.items() for x in (k, float(v[what])))), F.col("domain")).alias(f"domain_{what}")

    return mixed.select("doc_id", "n_words", "domain", top.alias("posterior"), "rate", mixing.copies().alias("copies"), told("target"), told("expected"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_pieces, op3_sstable, op4_quality, op5_licences, op6_language, op7_substring, op8_iblt, op9_mixing, op10_neighbours)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}
