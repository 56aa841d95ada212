"""Quality classifier: supervised subword embeddings on labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.subword import fit, posteriors

THRESHOLD = 0.3


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of the identifier as text leaves this remainder; false for a null identifier."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, by its whole text alone.

    Labels are learnt from rows with quality 0 or 1 whose identifier isn't held out; of more than
    max_train of them, a sample by hashed identifier. Null and empty texts get the score of the
    bias. Without usable labels every score is 0.5; if all labels agree, 0 or 1.
    """
    usable = labels.where("quality IN (0, 1)").where(~held_out(5, 0)).select("doc_id", F.col("quality").cast("string").alias("label"))
    model = fit(docs, usable, max_train)
    scored = posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    one = F.element_at("p", model.classes.index("1") + 1) if "1" in model.classes else F.lit(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), one))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
