"""Join-shaped operators of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise_combine(df: DataFrame, id_col: str) -> DataFrame:
    """Every unordered pair of rows, columns ending in 1 and 2; as many rows as pairs, so for small collections."""
    a, b = (df.select(*(F.col(c).alias(f"{c}{n}") for c in df.columns)) for n in (1, 2))
    return a.join(b, F.col(f"{id_col}1") < F.col(f"{id_col}2"))


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows joined by their place; as many as the shorter table has. Places are found by ranges of the order, not in one task."""
    return _placed(a, order_a).join(_placed(b, order_b), "_place").drop("_place")


def _placed(df: DataFrame, order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(x) for x in bounds)), lambda x: x < F.col(order))) if bounds else F.lit(0)
    parted = df.withColumn("_part", part)
    sizes = {r._part: r["count"] for r in parted.groupBy("_part").count().collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    w = Window.partitionBy("_part").orderBy(order)
    return parted.join(F.broadcast(offsets), "_part").withColumn("_place", F.col("_before") + F.row_number().over(w)).drop("_part", "_before")


def slice_rows(df: DataFrame, order: str, begin: int, end: int) -> DataFrame:
    """Rows at places begin to end (half open, from 0) by a numeric order without ties."""
    if end < begin:
        raise ValueError("a slice ends before it begins")
    return _placed(df, order).where(F.col("_place").between(begin + 1, end)).drop("_place")


def with_references(records: DataFrame, references: DataFrame) -> DataFrame:
    """Records with the index of their reference; unknown names are what unknown_references() returns."""
    return records.join(references.select(F.col("name").alias("ref_id"), F.col("index").alias("ref_index")), "ref_id", "left")


def unknown_references(records: DataFrame, references: DataFrame) -> DataFrame:
    return records.where("ref_id IS NOT NULL").join(references.select(F.col("name").alias("ref_id")), "ref_id", "left_anti")


def mates(records: DataFrame, placed: bool = False) -> DataFrame:
    """Pairs of the first and second records of the same id; with placed, only those that name each other's place as their mate's."""
    first = records.where(F.col("flag").bitwiseAND(0x40) != 0)
    second = records.where(F.col("flag").bitwiseAND(0x80) != 0)
    pairs = first.alias("first").join(second.alias("second"), F.col("first.id") == F.col("second.id"))
    if not placed:
        return pairs
    names = lambda a, b: F.col(f"{a}.mate.ref_id").eqNullSafe(F.col(f"{b}.ref_id")) & F.col(f"{a}.mate.pos").eqNullSafe(F.col(f"{b}.ref_offset"))
    return pairs.where(names("first", "second") & names("second", "first"))


def windows(hits: DataFrame, references: DataFrame, length: str, name: str = "window") -> DataFrame:
    """Hits with the part of their reference that begins there."""
    out = hits.join(references.select("reference_id", F.col("text").alias("_text")), "reference_id")
    return out.withColumn(name, F.substr("_text", F.col("reference_begin_position") + 1, F.col(length))).drop("_text")
