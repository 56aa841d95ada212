"""Queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: a warm median for each, and rates in the units of the operators.

The metric sums the headline queries; BENCH_ALL=1 also times all other sequence queries, once warm.
"""

import json
import os
import random
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seqframe.queries as base
from seqframe.kernels import align
from seqframe.operators import filters, kmers

NAMES = ["kmer_count", "kmer_distinct", "kmer_gapped", "minimiser_set", "revcomp", "translate_f0", "edit_distance", "global_affine", "search_exact", "search_hamming", "bin_count", "bloom_count", "cigar_rle", "zip_positional"]


def timed(df: DataFrame) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def rates(spark: SparkSession) -> dict[str, float]:
    """Letters, values or matrix cells a second, on inputs of the sizes the operators are usually measured with."""
    rng = random.Random(42)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    cells = lambda pairs: sum(len(a) * len(b) for a, b in pairs)
    out = {}
    for name, pairs, run in (
        ("affine 1024 pairs of 150, cells/s a core", [(word(150), word(150)) for _ in range(1024)], lambda p: align.affine_all(p, lambda x, y: 4 if x == y else -5, -10, -1)),
        ("edit 100 pairs of 500, cells/s a core", [(word(500), word(500)) for _ in range(100)], align.edit_all),
    ):
        t = time.time()
        run(pairs)
        out[name] = round(cells(pairs) / (time.time() - t))
    seqs = spark.createDataFrame([(word(50_000),) for _ in range(200)], "s string").repartition(16).cache()
    values = spark.range(2_000_000).withColumnRenamed("id", "v")
    f = filters.BloomFilter.build(values.limit(1000), "v", 1 << 20)
    for name, df, n in (
        ("k-mer hash k=8, letters/s", seqs.select(kmers.kmer_hash("s", 8)), 10_000_000),
        ("minimiser hash k=8 w=13, letters/s", seqs.select(kmers.minimiser_hash("s", 8, 13)), 10_000_000),
        ("Bloom filter of 2^20 bits, lookups/s", f.contains(values, "v"), 2_000_000),
    ):
        timed(df)
        out[name] = round(n / timed(df))
    return out


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every = base.queries()
    took = {name: round(statistics.median([timed(every[name](spark, sf)) for _ in range(3)][1:]), 3) for name in NAMES}
    more = {name: round([timed(f(spark, sf)) for _ in range(2)][1], 3) for name, f in every.items() if name not in NAMES} if os.environ.get("BENCH_ALL") else {}
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "others": more, "rates": rates(spark), "sf": sf}))


if __name__ == "__main__":
    main()
