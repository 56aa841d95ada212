"""Shared plumbing: intermediate tables, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one block of rows that a function gets at once.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Parts into which the rows of one key are dealt for joins; 64 at most, bits of a long.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/seqframe"


@contextlib.contextmanager
def own_actions(spark: SparkSession) -> Iterator[None]:
    """For actions that this library runs itself: batches to the workers of BLOCK_BYTES at most, and shuffle files that go
    when the action ends. What is built here but run by the caller has Spark's own bounds."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation.

    The shuffle files of the job that made it are of no more use and go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with own_actions(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the tables made by materialise() that these read and no later plan does."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, max(1, b.num_rows), step):
            yield b.slice(at, step)
        pa.default_memory_pool().release_unused()  # else the allocator keeps what a block took


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """df.mapInArrow(fn, schema), where fn gets blocks of so many rows and about so many bytes at most.

    The blocks are cut in the worker, from batches that Spark bounds by rows and bytes, so they
    depend neither on the session's settings nor on what else is built or run in it. A row larger
    than a block is a block of its own.
    """
    return df.mapInArrow(lambda batches: fn(_blocks(batches, rows, size)), schema)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def distinct_words(texts: pa.Array, separator: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text and the end, number of every word among the distinct ones, those as bytes).

    Words are cut at each separator, or without one at runs of ASCII white space, where none is empty.
    A null text counts as empty.
    """
    texts = texts.cast(pa.string()).fill_null("")
    split = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    starts = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    starts -= starts[0]
    number, words = flat.indices.to_numpy(), flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    if separator is None:
        empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
        if empty >= 0:  # before the first or after the last word of a text
            kept = number != empty
            starts = np.r_[0, np.cumsum(kept)][starts]
            number = number[kept]
    return starts, number, words


class WordRows:
    """A row of numbers for each word, found once per block and kept for words that a block has several times."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 200_000, block: int = 16_384) -> None:
        self.compute, self.limit, self.block = compute, limit, block
        self.store: dict[bytes, int] = {}
        self.table: np.ndarray | None = None

    def rows(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The rows of distinct words, of which a block has so many each."""
        words = words.tolist()
        if len(self.store) > self.limit:
            self.store, self.table = {}, None
        at = np.fromiter(map(self.store.get, words, itertools.repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0)
        new = [self.compute([words[i] for i in unseen[k : k + self.block].tolist()]) for k in range(0, len(unseen), self.block)] or [self.compute([])]
        table = np.concatenate([*([] if self.table is None else [self.table]), *new])
        start = len(table) - len(unseen)
        at[unseen] = start + np.arange(len(unseen))
        often = counts[unseen] > 1
        self.store.update(zip([words[i] for i in unseen[often].tolist()], range(start, start + int(often.sum())), strict=True))
        self.table = np.concatenate([table[:start], table[start:][often]])
        return table[at]


def gram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each <word>, word after word, and how many each word has; whole adds one bucket a word.

    All words lie in one array of code points, where a line feed, which no word holds, ends each of them.
    """
    units = np.frombuffer(("<" + ">\n<".join(words) + ">\n").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    last = units == 10
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    values, good = [], []
    if whole is not None:
        values.append(np.zeros(len(units), np.int64))
        values[0][starts] = whole
        good.append(np.zeros(len(units), bool))
        good[0][starts] = True
    key, inside = units.copy(), ~last
    for n in range(2, max(sizes) + 1):
        key *= np.uint64(0x100000001B3)
        key[: 1 - n] += units[n - 1 :]
        inside[: 1 - n] &= ~last[n - 1 :]
        inside[1 - n :] = False
        if n in sizes:
            mixed = key * np.uint64(0x9E3779B97F4A7C15)
            values.append(((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64))
            good.append(inside.copy())
    picked = np.column_stack(good)
    return np.column_stack(values)[picked], np.add.reduceat(picked.sum(axis=1), starts)


def with_totals(rows: DataFrame, keys: list[str], spread: list[str], total: Column, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """(rows with an aggregate of all rows of their keys, table of those aggregates).

    The aggregation sends one row a task and key, with a bit for each salt that the key's rows have; the
    join back is by keys and salt, a hash of other columns, so that no task gets all rows of one key.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    whole = rows.groupBy(*keys).agg(total, F.expr("bit_or(shiftleft(1L, salt))").alias("salts")).where(where)
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)
    whole = materialise(whole.withColumn("salt", F.explode(salts)).drop("salts"), "totals")
    return rows.join(whole, [*keys, "salt"]).drop("salt"), whole


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a long, b long); equal roots: connected.

    Each round hooks every node to its smallest neighbour, shortens the paths twice, and contracts
    the edges; an aggregation with partial sums and joins that AQE can split do all of it, so a
    node with very many links costs no task more than others.
    """
    spark = edges.sparkSession
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        first = up = materialise(up, "parents")
        for _ in range(2):
            over = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p").select("node", F.col("q").alias("p"))
        up = materialise(up, "parents")
        at = lambda end: up.select(F.col("node").alias(end), F.col("p").alias(f"p{end}"))
        before, edges = edges, materialise(
            edges.join(at("a"), "a").join(at("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
        release(before, first)
        if labels is None:
            labels = up.select("node", F.col("p").alias("root"))
        else:
            over = up.select(F.col("node").alias("root"), F.col("p").alias("q"))
            labels = labels.join(over, "root", "left").select("node", F.coalesce("q", "root").alias("root"))
    release(edges)
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels
