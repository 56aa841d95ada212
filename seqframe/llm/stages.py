"""Stages of the corpus pipeline: each takes and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm import language, mixing, pieces, quality, simhash, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a document's letters that its language must have.
LEAST_SHARE = 0.5
#: How often a document can enter the mixture.
MOST_COPIES = 16


def keep_language(docs: DataFrame) -> DataFrame:
    """Documents with a letter whose language has half of the letters; lang becomes the language found.

    Learns from the rows that have a language, but for those held out of op6. Null and empty texts
    have no language and go. Rows are judged one by one, so repeated rows, rows of one identifier and
    null identifiers stay as they are; columns but those of documents are dropped. An empty table
    stays empty.
    """
    model = language.fit(docs.where(~quality.held_out(4, 2)))
    found = language.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def one_of_each_group(docs: DataFrame, least_jaccard: float | None = None) -> DataFrame:
    """Of every near-duplicate group (five-word shingles) the row with the smallest doc_id, null being the largest.

    Rows of one identifier with different texts are different documents. Equal rows are copies, of
    which one stays, with the least of the other columns. Null and empty texts are copies of each
    other. Columns but those of documents are dropped; an empty table stays empty.
    """
    groups = simhash.grouped(docs, shingle=5, max_distance=4, least_jaccard=least_jaccard)
    first = F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "key")).alias("r")
    first = groups.groupBy("root").agg(first).select(F.col("r.id").alias("id"), F.col("r.key").alias("key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.struct(*COLUMNS).alias("row"))
    rows = rows.groupBy("id", "key").agg(F.min("row").alias("row"))
    same = rows["id"].eqNullSafe(first["id"]) & (rows["key"] == first["key"])
    return rows.join(first, same, "left_semi").select("row.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without the words that repeat earlier text; a document of which nothing is left goes.

    Rows of the same identifier and text get the same text. Texts that lose nothing stay as they are,
    null and empty ones too. Columns but those of documents are dropped; an empty table stays empty.
    """
    found = substring.dedup_substrings(docs.select(*COLUMNS), with_row=True)
    text = F.coalesce("kept", "row.text")
    return found.where("kept IS NULL OR kept <> ''").select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as often as their rate says; those likeliest of the clean domain have a rate of one or more, none of more than MOST_COPIES.

    Rows of the same identifier and text enter equally often; null identifiers and texts stay rows of
    their own. Columns but those of documents are dropped; an empty table stays empty.
    """
    clean = "q1t0"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    rates, _ = mixing.mix(rows, labels, keep=clean, least=1.0, most=MOST_COPIES, key=("doc_id", "key"))
    rates = rates.select(F.col("doc_id").alias("id"), "key", mixing.copies(key=("doc_id", "key")).cast("int").alias("often")).where("often > 0").dropDuplicates(["id", "key"])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.struct(*COLUMNS).alias("row"))
    out = rows.join(rates, rows["id"].eqNullSafe(rates["id"]) & (rows["key"] == rates["key"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("often")))).select("row.*")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """The digests of op2 for every document of the mixture."""
    return pieces.encoding_digests(docs, model)
