"""Streams of record files: new files of a directory, transformed by any column function, pushed to a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqframe.sources.files import read_sequences


def stream_sequences(spark: SparkSession, path: str, format: str, traits: str = "dna", max_files: int | None = None) -> DataFrame:
    """id, seq, qual of files as they arrive, at most max_files a batch; offsets are kept in the query's checkpoint, so a query restarts where it stopped."""
    return read_sequences(spark, path, format, traits, stream=True, max_files=max_files)


def on_result(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """callback(batch, number) for each batch; available files only."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
