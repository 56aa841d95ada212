"""k-mer hashes, minimisers, and hash functions of Bloom filters, in 64-bit unsigned arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from seqframe.alphabet import Alphabet, alphabet

# The default seed of canonical minimisers, and the seeds and multiplier of filter hashes.
MINIMISER_SEED = 0x8F3F73B5CF1C9ADE
HASH_SEEDS = (13572355802537770549, 13043817825332782213, 10650232656628343401, 16499269484942379435, 4893150838803335377)
GOLDEN = 11400714819323198485


@dataclass(frozen=True)
class Shape:
    """Which letters of a window count; the rightmost digit of the pattern is the window's leftmost letter."""

    pattern: str

    def __post_init__(self) -> None:
        p = self.pattern
        if not 1 <= len(p) <= 58 or set(p) - {"0", "1"} or p[0] != "1" or p[-1] != "1":
            raise ValueError("a shape has 1 to 58 binary digits and a 1 at both ends")

    @classmethod
    def ungapped(cls, k: int) -> Shape:
        return cls("1" * k)

    @property
    def size(self) -> int:
        return len(self.pattern)

    @property
    def places(self) -> list[int]:
        return [i for i, c in enumerate(reversed(self.pattern)) if c == "1"]


def shape_of(k: int | str | Shape) -> Shape:
    return k if isinstance(k, Shape) else Shape(k) if isinstance(k, str) else Shape.ungapped(k)


def ranks(seq: str, of: Alphabet) -> np.ndarray:
    table = np.full(0x250, of.rank(of.default), np.uint8)
    for c, v in of.mapping.items():
        table[ord(c)] = of.letters.index(v)
    codes = np.frombuffer(seq.encode("utf-32-le"), "<u4")
    return table[np.minimum(codes, len(table) - 1)]


def kmer_hash(r: np.ndarray, shape: Shape, sigma: int) -> np.ndarray:
    """Base-sigma number of the counted letters of every window."""
    places = shape.places
    if len(places) > 64 / math.log2(max(2, sigma)):
        raise ValueError("the shape is too large for 64 bits")
    n = len(r) - shape.size + 1
    h = np.zeros(max(0, n), np.uint64)
    for p in places if n > 0 else ():
        h = h * np.uint64(sigma) + r[p : p + n]
    return h


def minimiser(v: np.ndarray, w: int) -> np.ndarray:
    """Window minima, one for each change of the minimum's place; the rightmost counts on ties."""
    if w < 1:
        raise ValueError("the window is empty")
    w = min(w, len(v))
    if not w:
        return v[:0]
    windows = np.lib.stride_tricks.sliding_window_view(v, w)
    at = np.arange(len(windows)) + w - 1 - windows[:, ::-1].argmin(axis=1)  # the rightmost least value
    least = v[at]
    # a value counts until it leaves the window or a smaller one comes in; equal ones don't take over before
    falls = np.flatnonzero(np.r_[least[1:] < least[:-1], True])  # the next window has a smaller least value
    fall, place = falls[np.searchsorted(falls, np.arange(len(windows)))].tolist(), at.tolist()
    out, i = [], 0
    while i < len(place):
        out.append(place[i])
        i = min(place[i], fall[i]) + 1
    return v[out]


def minimiser_hash(seq: str, shape: Shape, window: int, seed: int = MINIMISER_SEED, of: Alphabet | None = None) -> np.ndarray:
    """Canonical minimisers: of each k-mer and its reverse complement the smaller hash, after XOR with the seed."""
    a = of or alphabet("dna4")
    if shape.size > window:
        raise ValueError("the shape is larger than the window")
    r = ranks(seq, a)
    partner = np.array([a.letters.index(c) for c in a.complement], np.uint8)
    there = kmer_hash(r, shape, a.size) ^ np.uint64(seed)
    back = (kmer_hash(partner[r][::-1], shape, a.size) ^ np.uint64(seed))[::-1]
    return minimiser(np.minimum(there, back), window - shape.size + 1)


def hash_and_fit(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Slots below size."""
    h = values.astype(np.uint64) * np.uint64(seed)
    h ^= h >> np.uint64(64 - int(size).bit_length())
    h = h * np.uint64(GOLDEN)
    low, high, s = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.uint64(size)
    if size < 1 << 32:
        return (high * s + ((low * s) >> np.uint64(32))) >> np.uint64(32)
    return np.array([(int(x) * size) >> 64 for x in h], np.uint64)
