"""Token ids in sorted-string-table shards, written and read by Spark's own file readers.

A shard holds a range of documents in ascending order of their identifier:

    data blocks     zstd; entries of a key prefix-compressed against the one before (each 16th key
                    stands whole, and a list of those places ends the block), and a value
    index block     for each data block: first key, offset, size, documents and ids before it
    filter block    Bloom filter of the keys
    footer          80 bytes: places of index and filter, counts, width of an id, magic

Every part is followed by one newline byte, so a shard is a text file of one row for each part:
Spark's committed text writer stores it on any file system, and a lost executor's task is simply
run again. Shards are cut by bytes, so whoever reads one holds a bounded part of the documents. A key is the identifier as eight big-endian bytes, sign flipped, so bytes sort as
numbers; null sorts first as an empty key. A value is the ids as little-endian integers.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm.util import distinct_words, map_batches, materialise, own_actions, shared_dir, utf8

MAGIC = b"SFSSTAB1"
FOOTER = struct.Struct("<8Q8s8s")
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 16, 10, 7
#: Words encoded as one text.
UNITS = 512
#: Words kept with their ids; beyond that the store is emptied before a block.
STORE = 250_000
#: Parts of a full shard, and the bytes at which a shard ends.
SHARD_PARTS, SHARD_BYTES = 1024, 64 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes (doc_id, ids) in ascending order and yields the parts of shards as they fill; each but the last has as many parts."""

    def __init__(self, width: int, parts: int, size: int) -> None:
        self.width, self.dtype, self.parts, self.size = width, np.dtype(f"<u{width}"), parts, size
        self.pack = zstandard.ZstdCompressor(level=1)
        self._begin()

    def _begin(self) -> None:
        self.offset = self.docs = self.tokens = self.written = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.digests: list[bytes] = []
        self._fresh()

    def _fresh(self) -> None:
        self.body, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.first, self.base = b"", (self.docs, self.tokens)

    def _part(self, part: bytes) -> bytes:
        self.offset += len(part) + 1
        self.written += 1
        return part

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        key, value = key_of(doc_id), ids.astype(self.dtype).tobytes()
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.body))
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        if not self.count:
            self.first = key
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        self.digests.append(key)
        if len(self.body) >= BLOCK_BYTES:
            yield self._flush()
            if self.written == self.parts - 3 or self.offset >= self.size:
                while self.written < self.parts - 3:
                    yield self._part(b"")
                yield from self.finish()

    def _flush(self) -> bytes:
        tail = struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        block = self.pack.compress(bytes(self.body) + tail)
        self.index.append((self.first, self.offset, len(block), *self.base))
        self._fresh()
        return self._part(block)

    def finish(self) -> Iterator[bytes]:
        """The parts that end the shard, if it has documents; what follows is another one."""
        if self.count:
            yield self._flush()
        if not self.docs:
            return
        bits = max(64, BLOOM_BITS * self.docs)
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        for key in self.digests:
            bloom[_bloom_places(key, bits)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(_varint(len(k)) + k + struct.pack("<4Q", *rest) for k, *rest in self.index)
        places = [self.offset, len(index)]
        yield self._part(index)
        places += [self.offset, len(bloom)]
        yield self._part(bloom)
        yield FOOTER.pack(*places, bits, self.docs, self.tokens, self.width, b"\0" * 8, MAGIC)
        self._begin()


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        at = len(data) - FOOTER.size - 1
        if at < 0:
            raise ValueError("not a shard")
        i, n, b, m, self.bits, self.docs, self.tokens, self.width, _, magic = FOOTER.unpack_from(self.data, at)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = np.dtype(f"<u{self.width}")
        self.bloom = self.data[b : b + m]
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        at, end = i, i + n
        while at < end:
            size, at = _read_varint(self.data, at)
            self.first.append(bytes(self.data[at : at + size]))
            self.blocks.append(struct.unpack_from("<4Q", self.data, at + size))
            at += size + 32
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, k: int) -> bytes:
        offset, size, _, _ = self.blocks[k]
        return self.unpack.decompress(self.data[offset : offset + size])

    def _entries(self, body: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def _restarts(self, body: bytes) -> tuple[list[int], int]:
        n = struct.unpack_from("<I", body, len(body) - 4)[0]
        end = len(body) - 4 - 4 * n
        return list(struct.unpack_from(f"<{n}I", body, end)), end

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the shard's documents before it, ids)."""
        for k in range(len(self.blocks)):
            body = self._block(k)
            start = self.blocks[k][3]
            for key, value in self._entries(body, 0, self._restarts(body)[1]):
                ids = np.frombuffer(value, self.dtype)
                yield id_of(key), start, ids
                start += len(ids)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the first document with this identifier: filter, binary search of index and restarts, then a short scan."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return None
        for k in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.first)):
            if self.first[k] > key:
                return None
            body = self._block(k)
            restarts, end = self._restarts(body)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if next(self._entries(body, restarts[mid], end))[0] < key:
                    lo = mid
                else:
                    hi = mid - 1
            for found, value in self._entries(body, restarts[lo], end):
                if found == key:
                    return np.frombuffer(value, self.dtype)
                if found > key:
                    break
        return None


class ByteTokenizer:
    """Ids of a byte-level BPE by the tokenizers library; each distinct word of a block is asked for once.

    A text cut before each single space and newline falls into parts that the pre-tokenizer treats
    alone, if it has no other white space, no two in a row, none at an end, and no special token.
    Other texts go to the library whole.
    """

    #: Bytes of texts for which that is sure: printable ASCII, newlines, Latin letters up to U+024F.
    FINE = bytes([10, *range(32, 127), *range(128, 192), *range(0xC2, 0xCA)])
    #: What must not be in such a text; the first of U+00A1 and below, of which some are white space.
    ODD = re.compile(b"\xc2[\x80-\xa0]|[ \n][ \n]|^[ \n]|[ \n]$|<\\|")

    @classmethod
    def splits(cls, text: bytes) -> bool:
        """Whether cutting the text changes none of its ids."""
        if text.translate(None, cls.FINE):
            return False
        if b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or b"<|" in text or b"\xc2" in text or text[:1] in b" \n" or text[-1:] in b" \n":
            return not cls.ODD.search(text)
        return True

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.batch = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.plain = self.lib.to_str().find('"ByteLevel"') >= 0 and self.lib.normalizer is None
        self.sizes = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), np.int64)  # bytes of each id: a byte is one letter of a token
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.store: dict[bytes, int] = {}  # words met several times in a block: their row in the two arrays
        self.ids, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _learn(self, first: list[bytes], rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in a row, how many each has) of units that begin a text, then of others: those follow
        a space or newline, are encoded in long texts, and are told apart by the bytes of their ids."""
        counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        for at in range(0, len(first), 4096):
            alone = [np.array(e.ids, self.dtype) for e in self.batch([u[1:].decode() for u in first[at : at + 4096]], add_special_tokens=False)]
            counts.append(np.array([len(x) for x in alone]))
            parts.extend(alone)
        for at in range(0, len(rest), UNITS):
            marked = [u if u[:1] == b"\n" else b" " + u for u in rest[at : at + UNITS]]
            ids = np.array(self.batch([b"".join(marked).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(m) for m in marked])) + 1
            counts.append(np.diff(np.r_[0, ends]))
            parts.append(ids.astype(self.dtype))
        return np.concatenate(parts), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a block; null counts as empty."""
        raw = utf8(texts)
        out = [np.zeros(0, self.dtype)] * len(raw)
        fine = np.array([bool(t) and self.plain and self.splits(t) for t in raw], bool)
        for i, t in enumerate(raw):
            if t and not fine[i]:
                out[i] = np.array(self.batch([t.decode()], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(fine)
        if not len(cut):
            return out
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts.take(pa.array(cut)), "\n", " \n"), "")
        starts, number, words = distinct_words(marked, " ")
        if len(self.store) > STORE:
            self._forget()
        words = words.tolist()
        row = np.fromiter(map(self.store.get, words, itertools.repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(row < 0).tolist()
        first, rest = [i for i in unseen if words[i][:1] == b"\0"], [i for i in unseen if words[i][:1] != b"\0"]
        unseen = np.array(first + rest, np.int64)
        ids, counts = self._learn([words[i] for i in first], [words[i] for i in rest])
        flat, ends = np.concatenate([self.ids, ids]), np.r_[self.ends, self.ends[-1] + np.cumsum(counts)]
        row[unseen] = len(self.ends) - 1 + np.arange(len(unseen))
        at, size = ends[row][number], (ends[row + 1] - ends[row])[number]
        stop = np.cumsum(size)
        every = flat[np.arange(stop[-1]) + np.repeat(at - stop + size, size)]
        stop = np.r_[0, stop][starts]
        for i, lo, hi in zip(cut.tolist(), stop[:-1].tolist(), stop[1:].tolist(), strict=True):
            out[i] = every[lo:hi]
        often = np.bincount(number, minlength=len(words))[unseen] > 1
        self.store.update(zip([words[i] for i in unseen[often].tolist()], range(len(self.ends) - 1, len(self.ends) - 1 + int(often.sum())), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, ids[np.repeat(often, counts)]]), np.r_[self.ends, self.ends[-1] + np.cumsum(counts[often])]
        return out


@functools.lru_cache(1)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None, shard_parts: int = SHARD_PARTS, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts, append end_id to each, and write shards in ascending order of the identifier.

    Null texts count as empty, a text of any length is one entry of one block. Rows of equal
    identifiers are all kept, in order of a hash of their texts; a null identifier comes first. An
    empty table gives no shard with documents. The only shuffle deals texts out by ranges of
    identifier and hash, so that very many rows of one identifier fall into several ranges. A range
    is as many shards as its bytes need: a shard of fewer than shard_parts parts is filled up with
    empty ones, and Spark's writer begins a file after each shard_parts parts.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        writer = ShardWriter(coder.width, shard_parts, shard_bytes)
        end = np.array(end_id, coder.dtype)
        for b in batches:
            parts = []
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1)), strict=True):
                parts.extend(writer.add(doc_id, np.append(ids, end)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])
        for part in writer.finish():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    parts = map_batches(rows, run, "part binary", size=6 << 20).select(F.col("part").cast("string").alias("value"))
    with own_actions(spark):
        parts.write.option("maxRecordsPerFile", shard_parts).text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the shards that hold documents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, ids_crc32 of every stored document, from the files' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, start, ids in Shard(data.as_buffer().to_pybytes())]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return map_batches(shard_files(spark, path), run, "shard string, doc_id long, local_start long, n_tokens long, ids_crc32 long", 1)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a stated list of identifiers; shards that the filter excludes aren't searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1):
                shard = Shard(data.as_buffer().to_pybytes())
                found = [(i, x.tolist()) for i in doc_ids if (x := shard.get(i)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_batches(shard_files(spark, path), run, "doc_id long, ids array<long>", 1)


def _place(name: str) -> tuple[int, int]:
    """Task and file of a shard by its name; shards in this order are in that of their documents."""
    task, file = re.search(r"part-(\d+)-.*-c(\d+)", name).groups()
    return int(task), int(file)


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards just written.

    start counts the ids of all documents before it; the offsets of shards come from one row each.
    Nulls, repeats and long texts are as write_shards() says; further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer, path)
    stored = materialise(read_shards(spark, path), "stored")
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total")).toLocalIterator()
    offsets, before = [], 0
    for r in sorted(totals, key=lambda r: _place(r.shard)):
        offsets.append((r.shard, before))
        before += r.total
    table = spark.createDataFrame(offsets, "shard string, before long")
    return stored.join(F.broadcast(table), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
