"""Command line: python -m seqframe.cli COMMAND ...; every command reads and writes whole folders or files through Spark."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions import letters
from seqframe.kernels.search import SearchConfig
from seqframe.operators import kmers
from seqframe.operators.search import search
from seqframe.plans.mapper import map_reads
from seqframe.sources import files

FORMATS = ("fasta", "fastq", "embl", "genbank")


def within(low: float, high: float, kind: type = int) -> Callable[[str], float]:
    """Validator of a number from low to high."""

    def check(text: str) -> float:
        x = kind(text)
        if not low <= x <= high:
            raise argparse.ArgumentTypeError(f"{x} is not within {low} and {high}")
        return x

    check.__name__ = kind.__name__
    return check


def with_ending(*formats: str) -> Callable[[str], str]:
    """Validator of a path whose ending is one of these formats'."""

    def check(path: str) -> str:
        try:
            found = files.format_of(path)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from e
        if found not in formats:
            raise argparse.ArgumentTypeError(f"{path} isn't {' or '.join(formats)}")
        return path

    check.__name__ = "path"
    return check


def _texts(spark: SparkSession, path: str, name: str, text: str) -> DataFrame:
    return files.read_sequences(spark, path, fields=("id", "seq")).select(F.col("id").alias(name), F.upper("seq").alias(text))


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_sequences(spark, a.input, traits=a.traits).where(letters.record_filter(a.min_length, a.min_quality))
    if a.reverse_complement:
        rows = rows.withColumn("seq", letters.reverse_complement("seq", "dna15")).withColumn("qual", F.reverse("qual"))
    files.write_sequences(rows, a.output, a.to, a.compression)


def count_kmers(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_sequences(spark, a.input, fields=("seq",)).select(letters.char_to("seq", "dna4").alias("seq"))
    kmers.spectrum(rows.select(kmers.kmer_hash("seq", a.shape or a.k).alias("h")), "h").write.parquet(a.output)


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    named = _texts(spark, a.queries, "name", "query")
    queries = named.withColumn("query_id", F.xxhash64("name", "query"))
    hits = search(queries, _texts(spark, a.references, "reference_id", "text"), SearchConfig(total=a.errors, hit=a.hit), a.k)
    hits.join(queries.select("query_id", "name").distinct(), "query_id").drop("query_id").write.parquet(a.output)


def map_(spark: SparkSession, a: argparse.Namespace) -> None:
    named = _texts(spark, a.queries, "name", "query")
    queries = named.select(F.xxhash64("name", "query").alias("query_id"), "query").distinct()
    found = map_reads(queries, _texts(spark, a.references, "reference_id", "text"), a.errors, a.k)
    names = named.withColumn("query_id", F.xxhash64("name", "query")).select("query_id", "name").distinct()
    found.join(names, "query_id").drop("query_id").write.parquet(a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqframe", description="Sequence files and searches on Spark.")
    p.add_argument("--version", action="version", version="seqframe 0.2.0")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("convert", help="write sequence files in another format")
    c.add_argument("input", type=with_ending(*FORMATS))
    c.add_argument("output")
    c.add_argument("--to", choices=FORMATS, required=True)
    c.add_argument("--traits", choices=("dna", "aa", "any"), default="dna")
    c.add_argument("--min-length", type=within(0, 1 << 31), default=0)
    c.add_argument("--min-quality", type=within(0, 93, float), default=0.0)
    c.add_argument("--compression", choices=("gzip", "bzip2"))
    c.add_argument("--reverse-complement", action="store_true")
    c.set_defaults(run=convert)

    k = sub.add_parser("kmers", help="count k-mers; a Parquet table of hash and n")
    k.add_argument("input", type=with_ending(*FORMATS))
    k.add_argument("output")
    k.add_argument("-k", type=within(1, 31), default=8)
    k.add_argument("--shape", help="1 for a letter that counts, 0 for one that doesn't")
    k.set_defaults(run=count_kmers)

    for name, run, text in (("search", find, "places of queries in references"), ("map", map_, "best places of reads, aligned")):
        s = sub.add_parser(name, help=text)
        s.add_argument("queries", type=with_ending(*FORMATS))
        s.add_argument("references", type=with_ending(*FORMATS))
        s.add_argument("output")
        s.add_argument("-e", "--errors", type=within(0, 255), default=0)
        s.add_argument("-k", type=within(1, 31), default=8)
        if name == "search":
            s.add_argument("--hit", choices=("all", "all_best", "single_best"), default="all")
        s.set_defaults(run=run)
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("seqframe").getOrCreate(), a)


if __name__ == "__main__":
    main()
