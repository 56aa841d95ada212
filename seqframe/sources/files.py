"""Record files as DataFrames.

Files are read through Spark's binaryFile source, so every file system, compression and directory of
files works, and a file is one task's work; FASTA also has a splittable reader. Writers format rows
in the tasks and use Spark's text writer, one file for each partition.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from seqframe.functions import sam, structure
from seqframe.sources import text as T

#: File name endings of each format.
EXTENSIONS = {
    "fasta": ("fasta", "fa", "fna", "ffn", "faa", "frn", "fas"), "fastq": ("fastq", "fq"), "embl": ("embl",), "genbank": ("genbank", "gb", "gbk"),
    "sam": ("sam",), "bam": ("bam",), "vienna": ("dbn",),
}


@dataclass(frozen=True)
class Format:
    """A record format: parse(text) yields rows of schema, write(rows) yields their text."""

    schema: str
    parse: Callable[[str], Iterator[tuple]]
    write: Callable[[Iterator[tuple]], Iterator[str]] | None = None


#: Formats added by their users.
OWN: dict[str, Format] = {}


def register_format(name: str, endings: tuple[str, ...], schema: str, parse: Callable[[str], Iterator[tuple]], write: Callable[[Iterator[tuple]], Iterator[str]] | None = None) -> None:
    """Make one's own format known to read_records(), write_records() and format_of(); schema has string and double columns."""
    taken = {e for n, es in EXTENSIONS.items() if n != name for e in es}
    if name in EXTENSIONS and name not in OWN or taken & set(endings):
        raise ValueError(f"{name} or its endings are taken")
    EXTENSIONS[name], OWN[name] = endings, Format(schema, parse, write)


def format_of(path: str) -> str:
    """Format by the ending, after those of compression; an unknown one raises an error."""
    parts = path.lower().rstrip("/").split(".")
    while parts and parts[-1] in ("gz", "bgzf", "bz2", "zst"):
        parts.pop()
    for name, endings in EXTENSIONS.items():
        if parts[-1] in endings:
            return name
    raise ValueError(f"unhandled extension: {path}")


#: Rows of a batch that a reader sends on at once.
ROWS = 4096


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], Iterator[tuple]], schema: str, mode: str, stream: bool = False, fields: tuple[str, ...] | None = None, max_files: int | None = None) -> DataFrame:
    types = dict(f.split() for f in schema.split(", "))
    names = list(fields or types)
    if unknown := set(names) - set(types):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    at = [list(types).index(n) for n in names]
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for row in parse(T.decompress(data).decode()):
                yield *(row[i] for i in at), None
        except T.ParseError as e:
            if mode == "FAILFAST":
                raise T.ParseError(f"{name}: {e}") from e
            yield *(None,) * len(names), str(e)

    kinds = [pa.float64() if types[n] == "double" else pa.string() for n in names] + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = chain.from_iterable(rows(name, data) for b in batches for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        while some := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [*names, "_corrupt_record"])

    out = reader.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", _corrupt_record string")
    return out if mode == "PERMISSIVE" else out.drop("_corrupt_record")


def read_sequences(spark: SparkSession, path: str, format: str | None = None, traits: str = "dna", mode: str = "FAILFAST", stream: bool = False, fields: tuple[str, ...] | None = None, max_files: int | None = None, **options: bool) -> DataFrame:
    """id, seq, qual, or the fields asked for in their order. traits: dna, aa or any; mode PERMISSIVE keeps what precedes an error and tells it in _corrupt_record."""
    parse = {
        "fasta": lambda t: T.read_fasta(t, traits, **options),
        "fastq": lambda t: T.read_fastq(t, traits, **options),
        "embl": lambda t: T.read_flat(t, "ID", "SQ", traits, **options),
        "genbank": lambda t: T.read_flat(t, "LOCUS", "ORIGIN", traits, **options),
    }[format or format_of(path)]
    return _parsed(spark, path, parse, "id string, seq string, qual string", mode, stream, fields, max_files)


def read_records(spark: SparkSession, path: str, format: str | None = None, mode: str = "FAILFAST", fields: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of files in a registered format."""
    own = OWN[format or format_of(path)]
    return _parsed(spark, path, own.parse, own.schema, mode, fields=fields)


def write_records(df: DataFrame, path: str, format: str, compression: str | None = None) -> None:
    own = OWN[format]
    if own.write is None:
        raise ValueError(f"{format} can't be written")
    _written(df, path, [f.split()[0] for f in own.schema.split(", ")], own.write, compression)


def read_fasta_split(spark: SparkSession, path: str, traits: str = "any") -> DataFrame:
    """id, seq of FASTA files with > markers, cut at records by Spark's text reader, so one large file is many tasks' work. Letters outside the traits raise an error."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.regexp_replace(record, "^[^\n]*", ""), r"[\s0-9]", "")
    if T.LEGAL[traits] is not None:
        seq = F.when(seq.rlike(f"^[{''.join(sorted(T.LEGAL[traits]))}]*$"), seq).otherwise(F.raise_error(F.lit("illegal letters")).cast("string"))
    return raw.select(F.trim(F.regexp_extract(record, "^[^\n]*", 0)).alias("id"), seq.alias("seq")).where("id <> '' OR seq <> ''")


def read_fastq_split(spark: SparkSession, path: str, traits: str = "dna") -> DataFrame:
    """id, seq, qual of FASTQ files with four lines a record, so that one large file is many tasks' work.

    Every task finds the first record of its own splits. Lines at the ends of splits, at most a few
    for each, are put together by a second, small branch of the plan, which reads the files again.
    """
    schema, fragment = "id string, seq string, qual string", "file string, start long, part int, lines array<string>"

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], T.FastqSplit, list[tuple[str, str, str]]]]:
        """(split, its state, new records); at the end of a split once more without records."""
        key, state = None, T.FastqSplit(traits)
        for b in batches:
            files, starts, lines = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(lines):
                now = files[at], starts[at]
                end = next((i for i in range(at + 1, len(lines)) if (files[i], starts[i]) != now), len(lines)) if (files[-1], starts[-1]) != now else len(lines)
                if now != key:
                    if key:
                        yield key, state, []
                    key, state = now, T.FastqSplit(traits)
                if found := state.feed(lines[at:end]):
                    yield key, state, found
                at = end
        if key:
            yield key, state, []

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found in splits(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["id", "seq", "qual"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), state, found in splits(batches):
            if not found:
                rows = [(file, start, part, lines) for part, lines in state.fragments()]
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "part", "lines"), r, strict=True)) for r in rows], pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("lines", pa.list_(pa.string()))]))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for lines in b.column(0).to_pylist() for r in T.fastq_records(lines, traits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], ["id", "seq", "qual"])

    text = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    order = Window.partitionBy("file").orderBy("start", "part")
    parts = text.mapInArrow(ends, fragment).withColumn("record", F.sum("part").over(order))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "lines"))), lambda x: x["lines"]))
    straddling = parts.groupBy("file", "record").agg(lines.alias("lines")).select("lines").mapInArrow(joined, schema)
    return text.mapInArrow(whole, schema).unionByName(straddling)


#: Columns that structure files have or that follow from them.
STRUCTURE_FIELDS = ("id", "seq", "structure", "energy", "bpp", "structured_seq")


def read_structures(spark: SparkSession, path: str, mode: str = "FAILFAST", fields: tuple[str, ...] = ("id", "seq", "structure", "energy")) -> DataFrame:
    """The fields asked for: id, seq, structure, energy; bpp (pairs with probability 1), structured_seq (letters with their structure)."""
    if unknown := set(fields) - set(STRUCTURE_FIELDS):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    rows = _parsed(spark, path, T.read_vienna, "id string, seq string, structure string, energy double", mode)
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    made = {"bpp": lambda: structure.bpp_from_structure("structure"), "structured_seq": lambda: F.zip_with(letters("seq"), letters("structure"), lambda a, b: F.struct(a.alias("letter"), b.alias("structure")))}
    extra = ["_corrupt_record"] if mode == "PERMISSIVE" else []
    return rows.select(*(made[f]().alias(f) if f in made else f for f in fields), *extra)


def _written(df: DataFrame, path: str, columns: list[str], write: Callable[[Iterator[tuple]], Iterator[str]], compression: str | None) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(write(rows)), pa.string())], ["value"])

    df.select(*columns).mapInArrow(run, "value string").write.text(path, compression=compression)


def write_sequences(df: DataFrame, path: str, format: str, compression: str | None = None, **options: object) -> None:
    """Rows (id, seq[, qual]) as files of a directory; order across files is the DataFrame's partition order."""
    columns = ["id", "seq", "qual"] if format == "fastq" else ["id", "seq"]
    write = {"fasta": T.write_fasta, "fastq": T.write_fastq, "embl": T.write_embl, "genbank": T.write_genbank}[format]
    _written(df, path, columns, lambda rows: write(rows, **options), compression)


def write_structures(df: DataFrame, path: str, precision: int = 6, compression: str | None = None) -> None:
    _written(df, path, ["id", "seq", "structure", "energy"], lambda rows: T.write_vienna(rows, precision), compression)


def _records(lines: DataFrame) -> DataFrame:
    """Typed columns of SAM lines (column value)."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, i - 1)
    some = lambda c: F.when(c != "*", c)
    pos = lambda c: F.when(c.cast("int") > 0, c.cast("int") - 1).when(c.cast("int") < 0, F.raise_error(F.lit("a negative position")).cast("int"))
    seq, qual = some(at(10)), some(at(11))
    checked = F.when(qual.isNull() | seq.isNull() | (F.length(seq) == F.length(qual)), qual).otherwise(F.raise_error(F.lit("sequence and qualities differ in length")).cast("string"))
    return lines.select(
        some(at(1)).alias("id"), at(2).cast("int").alias("flag"), some(at(3)).alias("ref_id"), pos(at(4)).alias("ref_offset"), at(5).cast("short").alias("mapq"), sam.parse_cigar(at(6)).alias("cigar"),
        F.struct(F.when(at(7) == "=", at(3)).when(at(7) != "*", at(7)).alias("ref_id"), pos(at(8)).alias("pos"), at(9).cast("int").alias("tlen")).alias("mate"),
        seq.alias("seq"), checked.alias("qual"), sam.parse_tags(F.slice(f, 12, F.greatest(F.lit(0), F.size(f) - 11))).alias("tags"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM files (also gz and bz2), in Spark's own expressions; positions count from 0."""
    return _records(spark.read.text(path).where("value <> '' AND NOT value LIKE '@__\t%'"))


def sam_header(spark: SparkSession, path: str) -> dict[str, list[dict[str, str]]]:
    lines = [r.value for r in spark.read.text(path).where("value LIKE '@__\t%'").collect()]
    return T.read_header("\n".join(lines))


def references(spark: SparkSession, header: dict[str, list[dict[str, str]]]) -> DataFrame:
    rows = [(i, x["SN"], int(x["LN"])) for i, x in enumerate(header["SQ"])]
    return spark.createDataFrame(rows, "index int, name string, length long")


#: Bytes that a reader of large files asks for at once.
PIECE = 4 << 20


def read_bam(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Records of BAM files; a file is one task's work.

    Files of over 2 GB need large: then tasks open them by pyarrow.fs, which must reach the folder,
    and hold a few MB at a time; else Spark's binaryFile source reads them whole.
    """
    found = spark.read.format("binaryFile").load(path)
    if not large:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(T.read_bam(T.decompress(data))[2], pa.string())], ["value"])

        return _records(found.select("content").mapInArrow(run, "value string"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(uri))
                with system.open_input_stream(name, compression=None) as f:
                    lines = T.bam_lines(T.inflated(iter(lambda f=f: f.read(PIECE), b"")))
                    while some := list(islice(lines, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])

    # one partition for each file, by a hash of its path
    files = found.select("path").repartition(max(1, len(found.inputFiles())), "path")
    return _records(files.mapInArrow(stream, "value string"))


def _uri(path: str) -> str:
    """A path as pyarrow.fs takes it."""
    for scheme, to in (("file:///", "file:///"), ("file:/", "file:///"), ("s3a://", "s3://"), ("s3n://", "s3://")):
        if path.startswith(scheme):
            return to + path[len(scheme) :]
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def sam_lines(records: DataFrame) -> DataFrame:
    """value: SAM text of records."""
    star = lambda c: F.coalesce(F.when(c == "", "*").otherwise(c), F.lit("*"))
    mate = F.when(F.col("mate.ref_id") == F.col("ref_id"), "=").otherwise(star(F.col("mate.ref_id")))
    one = lambda c: (F.coalesce(F.col(c), F.lit(-1)) + 1).cast("string")
    fields = [star(F.col("id")), F.col("flag").cast("string"), star(F.col("ref_id")), one("ref_offset"), F.col("mapq").cast("string"), sam.cigar_string("cigar"), mate, one("mate.pos"), F.coalesce("mate.tlen", F.lit(0)).cast("string"), star(F.col("seq")), star(F.col("qual"))]
    return records.select(F.concat_ws("\t", *fields, sam.tag_strings("tags")).alias("value"))


def _header_lines(refs: list[tuple[str, int]]) -> list[str]:
    return ["@HD\tVN:1.6", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in refs)]


def write_sam(records: DataFrame, path: str, refs: list[tuple[str, int]], compression: str | None = None) -> None:
    """One SAM file for each partition, each with the header; a reference that the header lacks raises an error."""
    head, known = _header_lines(refs), {"*", "=", *(n for n, _ in refs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for b in batches:
            for line in b.column(0).to_pylist():
                fields = line.split("\t", 7)
                if unknown := {fields[2], fields[6]} - known:
                    raise ValueError(f"{sorted(unknown)} not in the header")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    sam_lines(records).mapInArrow(run, "value string").write.text(path, compression=compression)


def bam_files(records: DataFrame, refs: list[tuple[str, int]]) -> DataFrame:
    """content binary: one BGZF-packed BAM file for each partition."""
    head = "\n".join(_header_lines(refs)) + "\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = b"".join(T.write_bam(head, refs, (x for b in batches for x in b.column(0).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

    return sam_lines(records).mapInArrow(run, "content binary")


def bam_header(spark: SparkSession, path: str) -> dict[str, list[dict[str, str]]]:
    """Header of the first of the BAM files; its references alone, if it has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                text, refs = T.read_bam_head(T.decompress(data))
                yield pa.RecordBatch.from_arrays([pa.array([text if "@SQ" in text else text + "\n".join(_header_lines(refs)[1:])])], ["text"])

    first = spark.read.format("binaryFile").load(path).orderBy("path").limit(1)
    return T.read_header(first.select("content").mapInArrow(run, "text string").first().text)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _BamWriter(DataSourceArrowWriter):
    """Tasks write under names of their own attempt; the commit gives the files of the attempts that count their names."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.header, self.refs = options["path"], options["header"], json.loads(options["refs"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        temporary = f"{folder}/_attempt-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            for block in T.write_bam(self.header, [(n, k) for n, k in self.refs], (x for b in iterator for x in b.column(0).to_pylist())):
                out.write(block)
        return _Written(temporary, f"{folder}/part-{task.partitionId():05d}.bam")

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                system.move(m.temporary, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                system.delete_file(m.temporary)


class BamSink(DataSource):
    """Spark data source that writes SAM lines (column value) as BAM files."""

    @classmethod
    def name(cls) -> str:
        return "seqframe_bam"

    def writer(self, schema: object, overwrite: bool) -> _BamWriter:
        return _BamWriter(dict(self.options))


def write_bam(records: DataFrame, path: str, refs: list[tuple[str, int]]) -> None:
    """One BAM file for each partition in the folder path (a URI that all executors can reach), streamed block by block."""
    spark = records.sparkSession
    spark.dataSource.register(BamSink)
    out = sam_lines(records).write.format("seqframe_bam").mode("append")
    out.option("header", "\n".join(_header_lines(refs)) + "\n").option("refs", json.dumps(refs)).save(_uri(path))
