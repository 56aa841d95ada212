"""k-mer and minimiser columns, spectra and set comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.alphabet import alphabet
from seqframe.functions.letters import _c
from seqframe.kernels import sequences as kernel


def kmer_hash(seq: str | Column, k: int | str | kernel.Shape, of: str = "dna4") -> Column:
    """array<bigint> of the hashes of all windows (two's complement); shapes are given by length or binary pattern."""
    shape, a = kernel.shape_of(k), alphabet(of)
    kernel.kmer_hash(kernel.ranks("", a), shape, a.size)

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel.kmer_hash(kernel.ranks(x, a), shape, a.size).view("int64") for x in s])

    return run(_c(seq))


def kmers(seq: str | Column, k: int) -> Column:
    """array<string> of all windows of k letters, in Spark's own expressions."""
    s = _c(seq)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_hash_native(seq: str | Column, k: int | str, of: str = "dna4") -> Column:
    """As kmer_hash, without Python; for hashes below 2^63 of short sequences."""
    shape, a = kernel.shape_of(k), alphabet(of)
    s, letters = _c(seq), F.lit(alphabet(of).letters)

    def one(i: Column) -> Column:
        h = F.lit(0).cast("bigint")
        for p in shape.places:
            h = h * a.size + (F.instr(letters, F.substr(s, i + p, F.lit(1))) - 1)
        return h

    return F.when(F.length(s) >= shape.size, F.transform(F.sequence(F.lit(1), F.length(s) - (shape.size - 1)), one)).otherwise(F.array().cast("array<bigint>"))


def minimiser(values: str | Column, w: int) -> Column:
    """Minimisers of an array<bigint>, whose values compare as signed numbers."""
    if w < 2:
        raise ValueError("the window must be larger than 1")

    @F.pandas_udf("array<bigint>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel.minimiser(x, w) for x in v])

    return run(_c(values))


def minimiser_of_two(a: str | Column, b: str | Column, w: int) -> Column:
    """Minimisers of the smaller element of two arrays of equal length."""
    return minimiser(F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y)), w)


def minimiser_hash(seq: str | Column, k: int | str, window: int, seed: int = kernel.MINIMISER_SEED) -> Column:
    shape = kernel.shape_of(k)
    kernel.minimiser_hash("", shape, window, seed)

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel.minimiser_hash(x, shape, window, seed).view("int64") for x in s])

    return run(_c(seq))


def spectrum(df: DataFrame, hashes: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., hash, n: how often each hash occurs; partial counts precede the shuffle."""
    return df.select(*by, F.explode(hashes).alias("hash")).groupBy(*by, "hash").agg(F.count(F.lit(1)).alias("n"))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared share of the distinct elements of two arrays."""
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both > 0, F.size(F.array_intersect(_c(a), _c(b))) / both).otherwise(0.0)


def containment(a: str | Column, b: str | Column) -> Column:
    own = F.size(F.array_distinct(_c(a)))
    return F.when(own > 0, F.size(F.array_intersect(_c(a), _c(b))) / own).otherwise(0.0)
