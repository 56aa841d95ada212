"""Pairwise alignment of many pairs at once: affine gaps (global, semi-global, local, banded) and edit distance.

Pairs of similar size are padded to one block, whose matrices grow column by column in numpy. Within
a column a gap in the first sequence can start at any row above; as opening one from within another
never pays, its best value is a running maximum over the cells without such gaps, found for the whole
column at once. Each cell keeps the step that gave its best value and whether the two gaps through it
open there; only the walk back along one path is done step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

LOW = -(10**9)
#: Steps: none, both letters, a letter of b alone, a letter of a alone; bits of gaps that open.
STOP, BOTH, B_ALONE, A_ALONE, B_OPENS, A_OPENS = 0, 1, 2, 3, 4, 8
#: Cells of a block.
CELLS = 1 << 23


@dataclass(frozen=True)
class Result:
    score: int
    begin1: int
    begin2: int
    end1: int
    end2: int
    aligned1: str
    aligned2: str


def _blocks(pairs: Sequence[tuple[str, str]]) -> list[list[int]]:
    """Indices of pairs of similar size, so many that a block's cells stay bounded (a larger pair is a block of its own)."""
    out: list[list[int]] = []
    wide = tall = 0
    for i in sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1]))):
        wide, tall = max(wide, len(pairs[i][0]) + 1), max(tall, len(pairs[i][1]) + 1)
        if out and (len(out[-1]) + 1) * wide * tall <= CELLS:
            out[-1].append(i)
        else:
            out.append([i])
            wide, tall = len(pairs[i][0]) + 1, len(pairs[i][1]) + 1
    return out


def _codes(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts), default=0)), np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = [letters[c] for c in t]
    return out


def affine_all(pairs: Sequence[tuple[str, str]], score: Callable[[str, str], int], gap_open: int = 0, gap_extend: int = -1, free: tuple[bool, bool, bool, bool] = (False,) * 4, local: bool = False, band: tuple[int, int] | None = None, last: bool = False) -> list[Result | None]:
    """Best alignment of each pair a (columns) and b (rows); a gap of n letters costs gap_open + n * gap_extend.

    free: leading and trailing ends of a, then of b. band: least and greatest column minus row.
    Of equal optima the first counts (columns, then rows), or with last the last one.
    """
    lead_a, trail_a, lead_b, trail_b = free
    if local:
        lead_a = lead_b = True
    for a, b in pairs if band else ():
        lo, hi = band
        over = len(a) - len(b)
        if lo > hi or (lo > 0 and not lead_a) or (hi < 0 and not lead_b) or (not local and ((hi < over and not trail_b) or (lo > over and not trail_a))):
            raise ValueError("the band can't hold an alignment")
    out: list[Result | None] = [None] * len(pairs)
    for block in _blocks(pairs):
        some = [pairs[i] for i in block]
        for i, r in zip(block, _affine_block(some, score, gap_open + gap_extend, gap_extend, (lead_a, trail_a, lead_b, trail_b), local, band, last), strict=True):
            out[i] = r
    return out


def _affine_block(pairs: list[tuple[str, str]], score: Callable, first: int, extend: int, free: tuple, local: bool, band: tuple[int, int] | None, last: bool) -> list[Result | None]:
    lead_a, trail_a, lead_b, trail_b = free
    letters = {c: i for i, c in enumerate(sorted({c for p in pairs for t in p for c in t}))}
    table = np.zeros((max(1, len(letters)),) * 2, np.int64)
    for p in {c for a, _ in pairs for c in a}:
        for q in {c for _, b in pairs for c in b}:
            table[letters[p], letters[q]] = score(p, q)
    a, b = (_codes([p[k] for p in pairs], letters) for k in (0, 1))
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    size, wide, tall = len(pairs), a.shape[1] + 1, b.shape[1] + 1
    row, every = np.arange(tall), np.arange(size)
    trace = np.zeros((wide, size, tall), np.uint8)
    best, end_c, end_r = np.full(size, LOW * 2), np.zeros(size, np.int64), np.zeros(size, np.int64)
    found = np.zeros(size, bool)
    before = along = opens = None  # values of the column before; gaps in b that reach this column, and whether they open here
    for c in range(wide):
        inside = (c - row >= band[0]) & (c - row <= band[1]) if band else np.ones(tall, bool)
        edge = 0 if lead_a or not c else first + extend * (c - 1)
        if not c:
            now = np.zeros((size, tall), np.int64)
            if not lead_b:
                now[:, 1:] = first + extend * (row[1:] - 1)
                trace[0, :, 1:] = B_ALONE
                trace[0, :, 1:2] |= B_OPENS
            now[:, ~inside] = LOW
            values = now
        else:
            both = np.full((size, tall), edge)
            both[:, 1:] = before[:, :-1] + table[a[:, c - 1, None], b]
            values = np.maximum(both, along)
            values[:, 0] = edge
            if local:
                values = np.maximum(values, 0)
            values[:, ~inside] = LOW
            # down[r]: best gap in a that reaches row r, from any row above
            down = np.full((size, tall), LOW)
            down[:, 1:] = np.maximum.accumulate(values - extend * row, axis=1)[:, :-1] + first + extend * (row[1:] - 1)
            starts = np.zeros((size, tall), bool)
            starts[:, 1:] = values[:, :-1] + first > down[:, :-1] + extend
            now = np.maximum(values, down)
            now[:, 0] = edge
            step = np.full((size, tall), BOTH, np.uint8)
            step[down > both] = B_ALONE
            step[along > np.maximum(both, down)] = A_ALONE
            step |= np.where(starts, B_OPENS, 0).astype(np.uint8) | np.where(opens, A_OPENS, 0).astype(np.uint8)
            if local:
                step[np.maximum(np.maximum(both, down), along) < 0] = STOP
                now = np.maximum(now, 0)
            step[:, 0] = STOP if lead_a else A_ALONE | (A_OPENS if c == 1 else 0)
            now[:, ~inside] = LOW
            trace[c] = step
        ends = np.zeros((size, tall), bool)
        if local:
            ends = (row <= m[:, None]) & (c <= n)[:, None]
        else:
            ends[every, m] = (c == n) | (trail_a & (c <= n))
            if trail_b:
                ends |= (c == n)[:, None] & (row <= m[:, None])
        ends &= inside
        offered = np.where(ends, now, LOW * 2)
        at = tall - 1 - offered[:, ::-1].argmax(axis=1) if last else offered.argmax(axis=1)
        value = offered[every, at]
        better = ends.any(axis=1) & ((value >= best) if last else (value > best))
        best, end_c, end_r, found = np.where(better, value, best), np.where(better, c, end_c), np.where(better, at, end_r), found | better
        start = now + first
        go_on = along + extend if along is not None else np.full((size, tall), LOW * 2)
        opens = start > go_on
        along = np.where(opens, start, go_on)
        along[:, ~inside] = LOW
        before = now
    return [_walk(pairs[i], trace[:, i], int(best[i]), int(end_c[i]), int(end_r[i])) if found[i] else None for i in range(size)]


def _walk(pair: tuple[str, str], trace: np.ndarray, score: int, c: int, r: int) -> Result:
    a, b = pair
    end, x, y = (c, r), [], []
    step = int(trace[c, r])
    way = step & 3
    while way and step:
        if way == B_ALONE:
            leave, r = step & B_OPENS, r - 1
            x.append("-")
            y.append(b[r])
        elif way == A_ALONE:
            leave, c = step & A_OPENS, c - 1
            x.append(a[c])
            y.append("-")
        else:
            leave, c, r = True, c - 1, r - 1
            x.append(a[c])
            y.append(b[r])
        step = int(trace[c, r])
        if leave:
            way = step & 3
    return Result(score, c, r, *end, "".join(reversed(x)), "".join(reversed(y)))


def affine(a: str, b: str, score: Callable[[str, str], int], gap_open: int = 0, gap_extend: int = -1, free: tuple[bool, bool, bool, bool] = (False,) * 4, local: bool = False, band: tuple[int, int] | None = None, last: bool = False) -> Result | None:
    """affine_all() of one pair."""
    return affine_all([(a, b)], score, gap_open, gap_extend, free, local, band, last)[0]


def edit_all(pairs: Sequence[tuple[str, str]], free_a: bool = False) -> list[Result]:
    """Unit-cost alignment of each pair; with free_a both ends of a are free. Score: minus the distance."""
    out: list[Result | None] = [None] * len(pairs)
    for block in _blocks(pairs):
        some = [pairs[i] for i in block]
        letters = {c: i for i, c in enumerate(sorted({c for p in some for t in p for c in t}))}
        a, b = (_codes([p[k] for p in some], letters) for k in (0, 1))
        row = np.arange(b.shape[1] + 1, dtype=np.int32)
        d = np.zeros((a.shape[1] + 1, len(some), len(row)), np.int32)
        d[0] = row
        for c in range(1, len(d)):
            d[c] = d[c - 1] + 1
            d[c, :, 1:] = np.minimum(d[c, :, 1:], d[c - 1, :, :-1] + (a[:, c - 1, None] != b))
            d[c, :, 0] = 0 if free_a else c
            d[c] = np.minimum.accumulate(d[c] - row, axis=1) + row
        for k, i in enumerate(block):
            out[i] = _walk_edit(*some[k], d[:, k], free_a)
    return out


def _walk_edit(a: str, b: str, d: np.ndarray, free_a: bool) -> Result:
    n, r = len(a), len(b)
    c = n - int(d[n::-1, r].argmin()) if free_a else n
    end, score, x, y = (c, r), -int(d[c, r]), [], []
    while r > 0 or (c > 0 and not free_a):
        if c > 0 and d[c, r] == d[c - 1, r] + 1:
            c -= 1
            x.append(a[c])
            y.append("-")
            continue
        r -= 1
        y.append(b[r])
        if d[c, r + 1] == d[c, r] + 1:
            x.append("-")
        else:
            c -= 1
            x.append(a[c])
    return Result(score, c, r, *end, "".join(reversed(x)), "".join(reversed(y)))


def edit(a: str, b: str, free_a: bool = False) -> Result:
    """edit_all() of one pair."""
    return edit_all([(a, b)], free_a)[0]


def cigar_from_alignment(x: str, y: str, clip_begin: int = 0, clip_end: int = 0, hard: bool = False, extended: bool = False) -> list[tuple[int, str]]:
    """Operations of an aligned pair, x the reference; with extended, = and X instead of M."""
    if len(x) != len(y) or not x:
        raise ValueError("the aligned sequences must have the same length and not be empty")
    out: list[list] = []
    kind = "H" if hard else "S"
    if clip_begin:
        out.append([clip_begin, kind])
    for p, q in zip(x, y, strict=True):
        op = "P" if p == q == "-" else "I" if p == "-" else "D" if q == "-" else ("=" if p == q else "X") if extended else "M"
        if out and out[-1][1] == op:
            out[-1][0] += 1
        else:
            out.append([1, op])
    if clip_end:
        out.append([clip_end, kind])
    return [tuple(o) for o in out]


def alignment_from_cigar(cigar: list[tuple[int, str]], reference: str, begin: int, query: str) -> tuple[str, str]:
    """Aligned reference and query."""
    if not cigar:
        raise ValueError("an empty CIGAR")
    if sum(n for n, o in cigar if o in "MIS=X") != len(query) or begin + sum(n for n, o in cigar if o in "MDN=X") > len(reference):
        raise ValueError("the CIGAR doesn't fit the sequences")
    x, y, r, q = [], [], begin, 0
    for n, o in cigar:
        if o in "M=X":
            x.append(reference[r : r + n])
            y.append(query[q : q + n])
            r, q = r + n, q + n
        elif o in "DN":
            x.append(reference[r : r + n])
            y.append("-" * n)
            r += n
        elif o == "I":
            x.append("-" * n)
            y.append(query[q : q + n])
            q += n
        elif o == "P":
            x.append("-" * n)
            y.append("-" * n)
        elif o == "S":
            q += n
    return "".join(x), "".join(y)


def format_alignment(x: str, y: str, width: int = 50) -> str:
    """Blocks with a bar between equal letters."""
    blocks = []
    for i in range(0, len(x), width):
        p, q = x[i : i + width], y[i : i + width]
        blocks.append(f"{i:>7} {p}\n        {''.join('|' if u == v and u != '-' else ' ' for u, v in zip(p, q, strict=True))}\n        {q}")
    return "\n\n".join(blocks)
