"""Approximate nearest neighbours by adaptive scans of rotated dimensions within probed lists.

Vectors are centred and rotated by a random orthogonal matrix, fitted with k-means lists on a
bounded sample; there are about as many lists as the root of the number of vectors. How many of its
nearest lists a query probes is measured on the sample: the fewest that hold the share RECALL of the
true neighbours of the sample's own queries, and always enough to hold several times k rows.

In the probed lists the rotated dimensions are scanned in blocks for many candidates at once; after
each block a hypothesis test abandons candidates whose partial distance, scaled to all dimensions,
exceeds the current k-th distance by more than its error bound (1 + eps / sqrt(d))^2. What is left is
measured in double precision on the original vectors.

Neighbouring lists are stored together in bins of bounded size, and a list with more rows than a bin
in several. A query goes once to each bin that has a probed list of its own, scans there its nearest
lists first, and gets at most k rows back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.util import map_batches, materialise

#: Rows of one bin.
CHUNK = 16384
#: Lists at most; rows of the sample; share of the true neighbours that the probed lists must hold in the sample.
MAX_LISTS, SAMPLE, RECALL = 2048, 16384, 0.98


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: no null, zero or non-finite vector or component, no null id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Lists:
    """Centre, rotation and list centres, from a sample."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centre = sample.mean(axis=0)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        turned = self.turned(sample)
        x = np.unique(turned, axis=0)
        self.centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, x)
            n = np.bincount(near, minlength=len(self.centres))
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], self.centres)
        # neighbouring lists get neighbouring numbers: along the direction in which the centres differ most
        spread = self.centres - self.centres.mean(axis=0)
        self.centres = self.centres[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        self.sample = turned

    def probes(self, k: int, recall: float, asked: int = 256) -> int:
        """The fewest nearest lists that hold this share of the k nearest of the sample to rows of the sample."""
        x = self.sample
        near = self.nearest(x, 1)[:, 0]
        places = []
        for q in range(0, len(x), max(1, len(x) // asked)):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            best = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            place = np.argsort(self.nearest(x[[q]], len(self.centres))[0])
            places.append(place[near[best]])
        places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        return int(places[int(np.ceil(recall * len(places))) - 1]) + 1 if len(places) else len(self.centres)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.rotation

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each rotated vector, nearest first."""
        n = min(n, len(self.centres))
        d = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(axis=1, kind="stable"), 1)


def adaptive_scan(query: np.ndarray, rows: np.ndarray, bound: float, block: int, eps: float) -> np.ndarray:
    """Indices of the rows that no test has abandoned; bound is the squared distance to beat (inf: none).

    Query and rows may have been rotated by products that round differently, so a bound of 0 has
    slack in proportion to the squared sizes of the query and the rows.
    """
    left, dim = np.arange(len(rows)), len(query)
    slack = 1e-24 * dim * max(query @ query, np.einsum("ij,ij->i", rows, rows).max(initial=0.0))
    partial = np.zeros(len(rows))
    for at in range(0, dim, block):
        part = rows[left, at : at + block] - query[at : at + block]
        partial = partial + np.einsum("ij,ij->i", part, part)
        seen = min(dim, at + block)
        limit = bound if seen == dim else bound * (seen / dim) * (1 + eps / np.sqrt(seen)) ** 2
        stay = partial <= limit * (1 + 1e-9) + slack
        left, partial = left[stay], partial[stay]
        if not len(left):
            break
    return left


def fit(vectors: DataFrame, lists: int | None = None, max_sample: int = SAMPLE) -> Lists | None:
    """Lists from all of (id, v), or about max_sample rows by hashed id; the commonest length of the sample is the dimension.

    Without a number of lists it is the root of the number of rows, MAX_LISTS at most.
    """
    n = vectors.count()
    if not n:
        return None
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, max_sample / n)))
    rows = [r.v for r in sample.orderBy("id").limit(2 * max_sample).collect()] or [r.v for r in vectors.limit(1).collect()]
    lengths = sorted(map(len, rows))
    dim = max(set(lengths), key=lambda k: (lengths.count(k), -k))
    return Lists(np.array([r for r in rows if len(r) == dim]), lists or min(MAX_LISTS, round(n**0.5)))


def bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each list, by the lists' rows: small ones follow in one bin, large ones have several."""
    first, many, at, held = [], [], 0, 0
    for n in sizes.tolist():
        if held and held + n > CHUNK:
            at, held = at + 1, 0
        first.append(at)
        many.append(max(1, -(-n // CHUNK)))
        if n > CHUNK:
            at, held = at + many[-1], 0
        else:
            held += n
    return np.array(first, np.int64), np.array(many, np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, recall: float = RECALL, block: int = 16, eps: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of queries, all rows of vectors being indexed.

    A row is no candidate of queries with its own id. Vectors of another length than the commonest
    take no part, nor do those that valid() leaves out. Equal distances go to the smaller id; of
    rows with the same id each counts. If there are fewer than k candidates, all are returned. An
    empty table gives an empty result; further columns have no influence, whatever their names.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    index = fit(rows, lists)
    if index is None:
        return spark.createDataFrame([], schema)
    dim, probed = index.dim, index.probes(k, recall)
    index.sample = None
    shared = spark.sparkContext.broadcast(pickle.dumps(index))  # lists x dimensions numbers

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for b in batches:
            near = own.nearest(own.turned(_matrix(b.column(1), dim)), 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["id", "v", "list"])

    listed = materialise(map_batches(rows.where(F.size("v") == dim), assign, "id long, v array<double>, list int"), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each list
        sizes[r.list] = r["count"]
    first, many = bins(sizes)
    of = spark.createDataFrame([(i, int(f), int(m)) for i, (f, m) in enumerate(zip(first, many, strict=True))], "list int, first long, many long")
    stored = listed.join(F.broadcast(of), "list").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("many")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's row for each bin with probed lists: as many as measured, and more until they hold 4 k rows besides its own."""
        own = pickle.loads(shared.value)
        for b in batches:
            at, to, chosen = [], [], []
            near = own.nearest(own.turned(_matrix(b.column(1), dim)), len(sizes)) if b.num_rows else []
            for i, order in enumerate(near):
                order = order[: max(probed, int(np.searchsorted(np.cumsum(sizes[order]), 4 * k + 1)) + 1)]
                order = order[sizes[order] > 0]
                spread = np.concatenate([np.arange(f, f + m) for f, m in zip(first[order], many[order], strict=True)])
                lists_of = np.repeat(order, many[order])
                by = np.argsort(spread, kind="stable")  # nearest list first in each bin
                for group in np.split(by, np.flatnonzero(np.diff(spread[by])) + 1):
                    at.append(i)
                    to.append(int(spread[group[0]]))
                    chosen.append(lists_of[group])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(to, pa.int64()), pa.array(chosen, pa.list_(pa.int32()))], ["id", "v", "bin", "lists"])

    probing = map_batches(asked.where(F.size("v") == dim), ask, "id long, v array<double>, bin long, lists array<int>", 256)
    columns = ["bin", "asks", "id", "v", "lists"]
    met = stored.withColumn("asks", F.lit(False)).withColumn("lists", F.array("list")).select(columns).union(probing.withColumn("asks", F.lit(True)).select(columns))
    met = met.repartition("bin").sortWithinPartitions("bin", "asks", F.get("lists", F.lit(0)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bin by list and id, then its queries."""
        own = pickle.loads(shared.value)
        current, ids, held, turned, of_list = None, np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros((0, dim)), np.zeros(0, np.int64)
        for b in batches:
            out: list[tuple[int, int, float]] = []
            place, asks, id_, v, chosen = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), _matrix(b.column(3), dim), b.column(4)
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (asks[1:] != asks[:-1])]) if len(place) else []
            for s, e in zip(edges, [*edges[1:], len(place)], strict=True):
                if current != place[s]:
                    current, ids, held, turned, of_list = place[s], ids[:0], held[:0], turned[:0], of_list[:0]
                if not asks[s]:
                    ids, held, turned = np.concatenate([ids, id_[s:e]]), np.vstack([held, v[s:e]]), np.vstack([turned, own.turned(v[s:e])])
                    of_list = np.concatenate([of_list, chosen.slice(s, e - s).flatten().to_numpy()])
                    continue
                for q, x, wanted in zip(id_[s:e].tolist(), v[s:e], chosen.slice(s, e - s), strict=True):
                    y = own.turned(x)
                    wanted = wanted.values.to_numpy()
                    lo, hi = np.searchsorted(of_list, wanted), np.searchsorted(of_list, wanted, "right")
                    rows = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True)])
                    found: list[tuple[float, int]] = []
                    for at in range(0, len(rows), 512):  # the bound sharpens from block to block
                        some = rows[at : at + 512]
                        left = some[adaptive_scan(y, turned[some], found[k - 1][0] if len(found) >= k else np.inf, block, eps)]
                        exact = held[left] - x
                        found += [(d, i) for d, i in zip(np.einsum("ij,ij->i", exact, exact).tolist(), ids[left].tolist(), strict=True) if i != q]
                        found = sorted(found)[:k]
                    out += [(q, i, d**0.5) for d, i in found]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = map_batches(met, run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
