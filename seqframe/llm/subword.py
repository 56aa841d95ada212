"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax output.

Training runs in one task over a sample whose size is a parameter. Scoring needs only the product
of the vectors and the output layer: a word adds one number per class, found once per distinct word.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.util import WordRows, distinct_words, gram_buckets, map_batches, utf8

#: Words whose n-grams are hashed at once.
BLOCK = 16_384


def features(words: list[bytes], buckets: int, sizes: tuple[int, ...] = (3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the character n-grams of <word>, word after word, and how many each word has."""
    whole = np.fromiter((zlib.crc32(w, 7) % buckets for w in words), np.int64, len(words))
    return gram_buckets(b"\n".join(words).decode("utf-8", "replace").split("\n"), sizes, buckets, whole)


class Model:
    """classes; effect: bucket x class, vectors times output layer; bias."""

    def __init__(self, classes: list[str], effect: np.ndarray, bias: np.ndarray) -> None:
        self.classes, self.effect, self.bias = classes, effect, bias
        self.known = WordRows(self._sums, block=BLOCK)

    def __reduce__(self) -> tuple:
        return Model, (self.classes, self.effect, self.bias)

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """Sum of effects and number of features of each word."""
        if not words:
            return np.zeros((0, len(self.classes) + 1))
        flat, sizes = features(words, len(self.effect))
        return np.column_stack([np.add.reduceat(self.effect[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=float), sizes])

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text x class probabilities, words of each text); a text without words has the bias alone."""
        starts, number, words = distinct_words(texts)
        logits = np.tile(self.bias, (len(texts), 1)).astype(float)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            rows = self.known.rows(words, np.bincount(number, minlength=len(words)))
            total = np.add.reduceat(rows[number], starts[some], axis=0)
            logits[some] += total[:, :-1] / total[:, -1:]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), np.diff(starts)


def train(texts: list[bytes], labels: list[str], buckets: int = 1 << 16, dim: int = 10, epochs: int = 5, rate: float = 0.6, seed: int = 5) -> Model:
    """Stochastic gradient descent over single documents, rate falling linearly to zero."""
    classes = sorted(set(labels))
    if not classes:
        return Model(["0", "1"], np.zeros((1, 2)), np.zeros(2))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    out, bias = np.zeros((dim, len(classes))), np.zeros(len(classes))
    docs = []
    for t in texts:
        count = Counter(t.split())
        flat, sizes = features(list(count), buckets) if count else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        weights = np.repeat(np.fromiter(count.values(), float, len(count)), sizes)
        index, inverse = np.unique(flat, return_inverse=True)
        share = np.bincount(inverse, weights, len(index)) if len(index) else np.zeros(0)
        docs.append((index.astype(np.int32), (share / max(1, share.sum())).astype(np.float32)))
    target = np.array([classes.index(x) for x in labels])
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - step / steps)
            step += 1
            index, share = docs[i]
            hidden = share @ vectors[index]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            if len(index):
                # a document's mean spreads the gradient thin; its features move by their relative share
                vectors[index] -= lr * (share / share.max())[:, None] * back
    return Model(classes, vectors @ out, bias)


def fit(docs: DataFrame, labelled: DataFrame, max_train: int = 3000, **options: float) -> Model:
    """Model of (doc_id, label string) rows and the texts of docs; of more rows, a sample of max_train by hashed doc_id.

    Rows without a label or identifier are left out; several labels of a document all count.
    """
    labelled = labelled.select("doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL").withColumn("order", F.xxhash64("doc_id", F.lit("sample")))
    n = labelled.count()
    if n > 2 * max_train:  # so that each task sends a share only
        labelled = labelled.where(F.pmod("order", F.lit(1 << 20)) < int((1 << 20) * 1.5 * max_train / n) + 1)
    sample = labelled.orderBy("order", "doc_id", "label").limit(max_train)
    joined = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(d, x, t) for b in batches for d, t, x in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True)})
        model = train([t for _, _, t in rows], [x for _, x, _ in rows], **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.classes, model.effect.astype(np.float32), model.bias))], pa.binary())], ["model"])

    made = map_batches(joined.repartition(1), run, "model binary").first()
    if made is None:  # no rows, no task
        return train([], [])
    classes, effect, bias = pickle.loads(made["model"])
    return Model(classes, effect, bias)


@functools.lru_cache(2)
def _loaded(data: bytes) -> Model:
    """One model for each worker process, with the words it has met."""
    return pickle.loads(data)


def posteriors(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., p array<double> in the order of model.classes, n_words long, for every whole text."""
    data = pickle.dumps(model)
    shared = docs.sparkSession.sparkContext.broadcast(data)  # buckets x classes numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shared.value)
        for b in batches:
            p, words = own.posteriors(b.column(len(keep)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], flat, pa.array(words)], [*keep, "p", "n_words"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, "text"), run, f"{fields}p array<double>, n_words long")
