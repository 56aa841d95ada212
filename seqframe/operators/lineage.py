"""Cutting of lineage for operators that move in steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder (spark.checkpoint.dir); one of its own only for a local master without any."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir() and named:
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seqframe-"))
    return df.checkpoint()
