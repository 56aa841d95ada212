"""SQL names for the main functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqframe.alphabet import alphabet
from seqframe.kernels import sequences as kernel


def register(spark: SparkSession) -> None:
    """reverse_complement, kmer_hashes(seq, k), and minimiser_hashes(seq, k, window) for DNA; explode() makes rows of their arrays."""
    dna, wide = alphabet("dna4"), alphabet("dna15")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURN reverse(translate(s, '{wide.letters}', '{wide.complement}'))")

    @F.pandas_udf("array<bigint>")
    def kmer_hashes(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([kernel.kmer_hash(kernel.ranks(x, dna), kernel.shape_of(int(n)), 4).view("int64") for x, n in zip(s, k, strict=True)])

    @F.pandas_udf("array<bigint>")
    def minimiser_hashes(s: pd.Series, k: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([kernel.minimiser_hash(x, kernel.shape_of(int(n)), int(m)).view("int64") for x, n, m in zip(s, k, w, strict=True)])

    for f in (kmer_hashes, minimiser_hashes):
        spark.udf.register(f.__name__, f)
