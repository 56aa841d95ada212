"""SimHash near-duplicate groups by a grid range-join under Manhattan distance.

Fingerprints are cut into two-bit segments. The bit counts of the 32 segments are a point whose
Manhattan distance to another point never exceeds the Hamming distance of the fingerprints. Writing
a count 0, 1, 2 in unary (00, 01, 11) makes that distance the bit count of an XOR.

Grid: the segments are dealt into max_distance + z consecutive groups, so of two fingerprints within
max_distance at least z groups agree in all counts (pigeonhole). Each choice of z groups is a grid,
in which a fingerprint has one cell, by the counts of those groups. In a cell, a search from every
member drops partners by the Manhattan bound, verifies the rest by their Hamming distance, and emits
only a spanning forest: the links that connect a cell's members, never all pairs of it.

z grows with the number of distinct fingerprints, so that a cell's expected share of them falls from
3e-5 (z = 2) by a factor of 20 for each step, and the work stays near the number of entries. A cell
with more than LIMIT members is split into blocks; a task gets two of its blocks at a time. Equal
fingerprints are one node, so copies cost nothing.

Texts of similarity 0.8 differ by 9 or 10 bits and more, where no grid of 64 bits is selective.
Links by similarity come from MinHash instead: texts that agree in a band of minima are candidates,
and sets of shingles, compared exactly, decide. A pair of Jaccard 0.8 misses all bands once in
38,000 times. Each band's members meet its first one; after that the members of bands that no links
connect yet are compared within a task, which sends on only links that connect something new.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.util import components, map_batches, materialise, release, utf8, with_totals

SEGMENTS = 32
SEED = 42
#: Members of a cell, or of two blocks of it at most twice as many, in one task.
LIMIT = 1 << 18
#: What an entry of the grid costs to shuffle, in comparisons.
ENTRY_COST = 20
#: Bands of so many minima each.
BANDS, MINIMA = 20, 4
#: Members of a band in one task, or of two blocks of it at most twice as many.
BLOCK = 4096
_ODD = np.random.default_rng(SEED).integers(0, 2**63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int) -> list[bytes]:
    """Lower-cased word shingles; no word: none; fewer words than a shingle: one."""
    words = text.lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in shingles(text, shingle)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of lower-cased word shingles; no word: 0; fewer words than a shingle: one shingle."""
    return _simhash(_hashes(text, shingle))


def _simhash(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # a bounded block of bits at a time
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of minima of the hashes, none without a hash."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * _ODD).min(axis=0), out=least)
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, with_bands: bool = False) -> DataFrame:
    """(id, key long, fp long): hash of the text and fingerprint of every row; null texts count as empty. with_bands adds bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [_hashes(t, shingle) for t in utf8(b.column(2))]
            columns = [b.column(0), b.column(1), pa.array(np.array([_simhash(h) for h in hashes], dtype=np.uint64).view(np.int64))]
            if with_bands:
                columns.append(pa.array([bands(h) for h in hashes], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "bands"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, key long, fp long" + ", bands array<long>" * with_bands)


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in unary."""
    even = np.uint64(0x5555555555555555)
    low, high = fp & even, (fp >> np.uint64(1)) & even
    return (low | high) | ((low & high) << np.uint64(1))


def fineness(n: int, max_distance: int) -> int:
    """z with the least work for n distinct fingerprints: entries, each with its expected partners and what an entry costs."""

    def work(z: int) -> float:
        groups = max_distance + z
        return math.comb(groups, z) * (ENTRY_COST + n * (3 / 8) ** (SEGMENTS * z / groups))

    return min(range(1, SEGMENTS - max_distance + 1), key=work)


def cells(fp: np.ndarray, max_distance: int, z: int) -> np.ndarray:
    """grid x fingerprint: the cell of every fingerprint in each grid, a 64-bit key that equal counts share."""
    u, groups = unary_counts(fp), max_distance + z
    bounds = [2 * round(g * SEGMENTS / groups) for g in range(groups + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    out = []
    for i, chosen in enumerate(itertools.combinations(masks, z)):
        key = (u & np.uint64(sum(chosen))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
        out.append((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))  # one to one for each i
    return np.array(out, np.uint64)


def forest(fp: np.ndarray, max_distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what a cell links.

    Only members not yet reached are compared, so a tight group of n costs about n comparisons.
    """
    u, out = unary_counts(fp), []
    left = np.arange(len(fp))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(u[left] ^ u[x]) <= max_distance  # lower bound
            if not near.any():
                continue
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= max_distance  # exact
            found = left[near]
            if len(found):
                out.append((np.full(len(found), fp[x]), fp[found]))
                front.extend(found)
                left = left[~near]
    return out


def _block_pairs(key: str) -> Column:
    """Parts in which a member meets all others of a group of so many blocks (column blocks): its own block with each one."""
    own = F.pmod(F.xxhash64(key), F.col("blocks"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of one group of the first columns each; an empty slice follows the last of each group."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            group = tuple(c[lo] for c in columns)
            if last is not None and group != last:
                yield b.slice(0, 0)
            last = group
            yield b.slice(lo, hi - lo)
    if last is not None:
        yield b.slice(0, 0)


def links(distinct: DataFrame, max_distance: int = 4, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    n = distinct.count()
    z = fineness(n, max_distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            cell = cells(fp.view(np.uint64), max_distance, z)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), pa.array(np.tile(fp, len(cell)))], ["cell", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cell, part, fp) in order of cell and part."""

        def linked(cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[starts[1:], len(cell)]
            some = ends - starts > 1
            found = [e for s, t in zip(starts[some], ends[some], strict=True) for e in forest(fp[s:t], max_distance)]
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (zip(*found, strict=True) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        kept: list[list[np.ndarray]] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[2] = new[2].view(np.uint64)
            if not len(new[0]):
                continue
            if kept and (kept[-1][0][-1], kept[-1][1][-1]) == (new[0][-1], new[1][-1]):  # one cell goes on
                kept.append(new)
                continue
            done = int(np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))[-1]) + 1 if (new[0][0], new[1][0]) != (new[0][-1], new[1][-1]) else 0
            yield linked(*(np.concatenate(x) for x in zip(*kept, [x[:done] for x in new], strict=True)))
            kept = [[x[done:] for x in new]]
        if kept:
            yield linked(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    grid = map_batches(distinct.select("fp"), spread, "cell long, fp long", 4096).withColumn("part", F.lit(0).cast("long"))
    if n > limit:  # otherwise no cell can have as many members
        full = grid.groupBy("cell").count().where(F.col("count") > limit).select("cell", F.ceil(F.col("count") / limit).alias("blocks"))
        grid = grid.join(full, "cell", "left").withColumn("part", F.explode(F.when(F.col("blocks").isNotNull(), _block_pairs("fp")).otherwise(F.array("part"))))
    grid = grid.select("cell", "part", "fp").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return map_batches(grid, search, "a long, b long", 1 << 16)


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b): the fingerprints of those (x, y) of pairs whose texts (key, text) have sets of shingles of that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                s, t = set(shingles(x, shingle)), set(shingles(y, shingle))
                both = len(s & t)
                if both >= least * (len(s) + len(t) - both):
                    found.append((fingerprint(x, shingle), fingerprint(y, shingle)))
            fp = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["a", "b"])

    first, second = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in ("x", "y"))
    return map_batches(pairs.join(first, "x").join(second, "y").select("text_x", "text_y"), run, "a long, b long", 64)


def similar_links(docs: DataFrame, fps: DataFrame, near: DataFrame, text_col: str, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) between fingerprints that, with the edges near, connect all texts of that similarity which share a band.

    fps is with_fingerprints(docs, with_bands=True). Equal texts are one node here, whatever their number.
    """
    nodes = fps.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    entries = nodes.select("key", "fp", F.explode("bands").alias("band"))
    ends = F.struct(F.min("key").alias("hub"), F.max("key").alias("last")).alias("ends")
    entries, shared = with_totals(entries, ["band"], ["key"], ends, "ends.hub < ends.last")
    entries = materialise(entries.select("key", "fp", "band", F.col("ends.hub").alias("hub")), "bands")
    release(shared)
    met = entries.select("key").distinct()
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).join(met, "key", "left_semi")
    texts = materialise(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")
    stars = entries.where("key <> hub").select(F.col("hub").alias("x"), F.col("key").alias("y")).distinct()
    edges = materialise(_similar(stars, texts, shingle, least), "similar")
    roots = materialise(components(near.union(edges)), "roots")
    named = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("band", "key", "fp", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    open_ = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("low < high")
    named = materialise(named.join(open_.select("band", "blocks"), "band"), "open")
    more = materialise(_unconnected(named, texts, shingle, least), "similar")
    found = edges.union(more)
    release(entries, texts, roots, named)
    return found


def _unconnected(members: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b): fingerprints of texts of that similarity that share a band (band, blocks, key, fp, root) but not yet a root.

    A band's members come to one task with their sets of shingles, hashed; of more than BLOCK members
    two blocks at a time. Those of one root are taken as connected, others are compared with members
    reached so far, so only links that connect something new are sent on, never all pairs.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_hashes(t, shingle)).view(np.int64) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    def linked(fp: np.ndarray, root: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        words, flat = np.unique(flat, return_inverse=True)
        ends = np.cumsum(sizes)
        one, other = [], []
        left = np.arange(len(fp))
        own = np.zeros(len(words), bool)
        while len(left):
            reached = root[left] == root[left[0]]
            front, left = left[reached].tolist(), left[~reached]
            while front and len(left):
                x = front.pop()
                own[flat[ends[x] - sizes[x] : ends[x]]] = True
                begin = np.cumsum(sizes[left]) - sizes[left]
                of = flat[np.arange(sizes[left].sum()) + np.repeat(ends[left] - sizes[left] - begin, sizes[left])]
                both = np.add.reduceat(own[of], begin, dtype=np.int64)
                own[:] = False
                near = both >= least * (sizes[x] + sizes[left] - both)
                if near.any():
                    one += [fp[x]] * int(near.sum())
                    other += fp[left[near]].tolist()
                    reached = np.isin(root[left], root[left[near]])
                    front += left[reached].tolist()
                    left = left[~reached]
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _groups(batches, 2):
            held.append(b)
            if b.num_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()  # a group has ended
            held = []
            if t.num_rows > 1:
                lists = t.column("shingles").combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                yield linked(t.column("fp").to_numpy(), t.column("root").to_numpy(), lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64))

    met = members.select("key").distinct()
    sets = map_batches(texts.join(met, "key", "left_semi").select("key", "text"), hashed, "key long, shingles array<long>")
    rows = members.join(sets, "key").withColumn("part", F.explode(_block_pairs("key")))
    rows = rows.select("band", "part", "fp", "root", "shingles").repartition("band", "part").sortWithinPartitions("band", "part")
    return map_batches(rows, search, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, least_jaccard: float | None = None) -> DataFrame:
    """(id, key, fp, component_id, root) of every row: key is a hash of the text, root the same for all rows of a group."""
    fps = materialise(with_fingerprints(docs, id_col, text_col, shingle, least_jaccard is not None), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    edges = materialise(links(nodes, max_distance), "near")
    if least_jaccard is not None:
        more = similar_links(docs, fps, edges, text_col, shingle, least_jaccard)
        near, edges = edges, materialise(edges.union(more), "near")
        release(near, more)
    joined = materialise(components(edges).withColumnRenamed("node", "fp").join(nodes, "fp"), "roots")
    least = joined.groupBy("root").agg(F.min("first").alias("cid"))
    named = nodes.join(joined.join(least, "root").select("fp", "root", "cid"), "fp", "left")
    named = materialise(named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("cid", "first").alias("component_id")), "named")
    release(nodes, edges, joined)
    return fps.join(named, "fp", "left").select("id", "key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, least_jaccard: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs, by words of whole texts of any length.

    component_id is the smallest id that links of max_distance bits or fewer reach, and with
    least_jaccard also links of texts whose shingles have that Jaccard similarity or more. Null and empty
    texts have fingerprint 0 and are linked like others. Rows with equal ids or texts are all
    returned; ids that are null are returned and never name a component unless all its ids are
    null. Further columns of docs are ignored. An empty table gives an empty result.
    """
    found = grouped(docs, id_col, text_col, shingle, max_distance, least_jaccard)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
