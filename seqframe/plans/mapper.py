"""Read mapping: search, alignment of the hits' windows, alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.kernels.search import SearchConfig
from seqframe.operators import alignments as A
from seqframe.operators.joins import windows
from seqframe.operators.search import search


def map_reads(reads: DataFrame, refs: DataFrame, errors: int = 2, k: int = 8) -> DataFrame:
    """Records of reads (query_id, query) on references (reference_id, text): best hits, aligned with the window's ends free."""
    hits = search(reads, refs, SearchConfig(total=errors, hit="all_best"), k)
    placed = windows(hits.join(reads, "query_id").withColumn("_n", F.length("query") + errors), refs, "_n")
    cfg = A.AlignConfig(free_ends=(True, True, False, False))
    r = placed.withColumn("r", A.align_pairwise("window", "query", cfg))
    return r.select(
        "query_id", "reference_id", (F.col("reference_begin_position") + F.col("r.begin1")).alias("ref_offset"), (F.col("r.score") + 60).cast("short").alias("mapq"),
        A.cigar_from_alignment("r.aligned1", "r.aligned2").alias("cigar"), "query",
    )
