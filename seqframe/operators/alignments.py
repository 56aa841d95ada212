"""Pairwise alignment of two string columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqframe.alphabet import alphabet
from seqframe.functions.letters import _c
from seqframe.kernels import align as kernel

RESULT = "struct<score:int,begin1:int,begin2:int,end1:int,end2:int,aligned1:string,aligned2:string>"
CIGAR = "array<struct<count:int,op:string>>"


def simple_scheme(match: int = 0, mismatch: int = -1) -> dict:
    return {"match": match, "mismatch": mismatch}


def read_matrix(text: str) -> dict:
    """A substitution matrix in the usual text form: a line of letters, then a line for each letter; # starts a comment."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {"matrix": {(row[0], c): int(v) for row in lines[1:] for c, v in zip(lines[0], row[1:], strict=True)}}


def _scores(of: str, score: Callable[[str, str], int]) -> dict:
    a = alphabet(of)
    table = {(p, q): score(p, q) for p in a.letters for q in a.letters}
    if any(not -128 <= v <= 127 for v in table.values()):
        raise ValueError("a score is not within -128 and 127")
    return {"matrix": table, "alphabet": of}


def nucleotide_scheme(match: int = 0, mismatch: int = -1, matrix: dict[tuple[str, str], int] | None = None) -> dict:
    """Scores of letters after conversion to dna15; a matrix has a score for each pair of its 15 letters."""
    return _scores("dna15", (lambda p, q: matrix[p, q]) if matrix else lambda p, q: match if p == q else mismatch)


def aminoacid_scheme(matrix: str | dict[tuple[str, str], int]) -> dict:
    """Scores of letters after conversion to aa27, from a matrix or its text. A letter without a row is scored as X."""
    table = read_matrix(matrix)["matrix"] if isinstance(matrix, str) else matrix
    held = {p for p, _ in table}
    known = lambda c: c if c in held else "X"
    return _scores("aa27", lambda p, q: table[known(p), known(q)])


def scheme_text(scheme: dict) -> str:
    """A scheme of numbers as text; scheme_of() reads it."""
    return json.dumps(scheme | {"matrix": [[p, q, v] for (p, q), v in scheme["matrix"].items()]} if "matrix" in scheme else scheme)


def scheme_of(text: str) -> dict:
    out = json.loads(text)
    return out | {"matrix": {(p, q): v for p, q, v in out["matrix"]}} if "matrix" in out else out


@dataclass(frozen=True)
class AlignConfig:
    """method: global or local; free_ends: leading and trailing ends of sequence 1, then of sequence 2."""

    scheme: dict | Callable[[str, str], int] = field(default_factory=simple_scheme)
    gap_open: int = 0
    gap_extend: int = -1
    method: str = "global"
    free_ends: tuple[bool, bool, bool, bool] = (False, False, False, False)
    band: tuple[int, int] | None = None
    min_score: int | None = None

    def __post_init__(self) -> None:
        if self.gap_open > 0 or self.gap_extend > 0:
            raise ValueError("gap scores must not be positive")
        if self.method not in ("global", "local"):
            raise ValueError("unknown method")
        if self.method == "local" and (any(self.free_ends) or self.min_score is not None):
            raise ValueError("local alignment has neither free ends nor a least score")
        if self.min_score is not None and not self.edit:
            raise ValueError("a least score needs the edit distance scheme")

    @property
    def edit(self) -> bool:
        f = self.free_ends
        unit = self.scheme == simple_scheme() and (self.gap_open, self.gap_extend) == (0, -1)
        return unit and self.method == "global" and self.band is None and f[0] == f[1] and not f[2] and not f[3]

    def score_of(self) -> Callable[[str, str], int]:
        if callable(self.scheme):
            return self.scheme
        if "matrix" in self.scheme:
            table = self.scheme["matrix"]
            if "alphabet" not in self.scheme:
                return lambda p, q: table[p, q]
            a = alphabet(self.scheme["alphabet"])
            letter = lambda c: a.mapping.get(c, a.default)
            return lambda p, q: table[letter(p), letter(q)]
        m, x = self.scheme["match"], self.scheme["mismatch"]
        return lambda p, q: m if p == q else x


def align_pairwise(seq1: str | Column, seq2: str | Column, config: AlignConfig | None = None) -> Column:
    """Struct of score, half-open coordinates and aligned sequences; null if a sequence is null or the least score isn't reached."""
    cfg = config or AlignConfig()

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        a, b = a.tolist(), b.tolist()
        whole = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
        pairs = [(a[i], b[i]) for i in whole]
        found = kernel.edit_all(pairs, cfg.free_ends[0]) if cfg.edit else kernel.affine_all(pairs, cfg.score_of(), cfg.gap_open, cfg.gap_extend, cfg.free_ends, cfg.method == "local", cfg.band)
        rows = [(None,) * 7] * len(a)
        for i, r in zip(whole, found, strict=True):
            if r and (cfg.min_score is None or r.score >= cfg.min_score):
                rows[i] = (r.score, r.begin1, r.begin2, r.end1, r.end2, r.aligned1, r.aligned2)
        return pd.DataFrame(rows, columns=["score", "begin1", "begin2", "end1", "end2", "aligned1", "aligned2"])

    return run(_c(seq1), _c(seq2))


def edit_score(seq1: str | Column, seq2: str | Column, min_score: int | None = None) -> Column:
    """Minus the edit distance, in Spark's own expression; null below min_score."""
    if min_score is None:
        return -F.levenshtein(_c(seq1), _c(seq2))
    d = F.levenshtein(_c(seq1), _c(seq2), -min_score)
    return F.when(d >= 0, -d)


def hamming_score(seq1: str | Column, seq2: str | Column) -> Column:
    """Minus the number of places that differ, of sequences of equal length; else null."""
    a, b = (F.filter(F.split(_c(x), ""), lambda c: c != "") for x in (seq1, seq2))
    return F.when(F.length(_c(seq1)) == F.length(_c(seq2)), -F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)))


def cigar_from_alignment(aligned1: str | Column, aligned2: str | Column, extended: bool = False) -> Column:
    @F.pandas_udf(CIGAR)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"count": n, "op": o} for n, o in kernel.cigar_from_alignment(x, y, extended=extended)] for x, y in zip(a, b, strict=True)])

    return run(_c(aligned1), _c(aligned2))


def alignment_from_cigar(cigar: str | Column, reference: str | Column, begin: str | Column, query: str | Column) -> Column:
    """struct<reference, query> of the aligned pair; cigar is SAM text."""

    @F.pandas_udf("struct<reference:string,query:string>")
    def run(c: pd.Series, r: pd.Series, at: pd.Series, q: pd.Series) -> pd.DataFrame:
        import re

        rows = [kernel.alignment_from_cigar([(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", x)], y, int(z), w) for x, y, z, w in zip(c, r, at, q, strict=True)]
        return pd.DataFrame(rows, columns=["reference", "query"])

    return run(_c(cigar), _c(reference), _c(begin), _c(query))


def _n(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def insert_gap(seq: str | Column, at: int | Column, n: int | Column = 1) -> Column:
    """n gaps before place at (a number or a column)."""
    s, at, n = _c(seq), _n(at), _n(n)
    return F.concat(F.substr(s, F.lit(1), at), F.repeat(F.lit("-"), n), F.substr(s, at + 1))


def erase_gap(seq: str | Column, at: int | Column, n: int | Column = 1) -> Column:
    """n gaps from place at removed; a letter there raises an error."""
    s, at, n = _c(seq), _n(at), _n(n)
    return F.when(F.substr(s, at + 1, n) == F.repeat(F.lit("-"), n), F.concat(F.substr(s, F.lit(1), at), F.substr(s, at + n + 1))).otherwise(F.raise_error(F.lit("not a gap")).cast("string"))


def gap_runs(seq: str | Column) -> Column:
    """array<struct<at, n>>: the gaps of a sequence, each with the place of the ungapped letter that follows it."""
    pieces = F.regexp_extract_all(_c(seq), F.lit("(-+|[^-]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("runs"))
    gap = lambda p: p.startswith("-")
    step = lambda a, p: F.struct((a["at"] + F.when(gap(p), 0).otherwise(F.length(p))).alias("at"), F.when(gap(p), F.concat(a["runs"], F.array(F.struct(a["at"].alias("at"), F.length(p).alias("n"))))).otherwise(a["runs"]).alias("runs"))
    return F.aggregate(pieces, start, step, lambda a: a["runs"])


def with_gap_runs(seq: str | Column, runs: str | Column) -> Column:
    """An ungapped sequence with the gaps of gap_runs()."""
    s, r = _c(seq), _c(runs)
    pieces = F.transform(r, lambda x, i: F.concat(F.substr(s, F.when(i == 0, 0).otherwise(F.get(r, i - 1)["at"]) + 1, x["at"] - F.when(i == 0, 0).otherwise(F.get(r, i - 1)["at"])), F.repeat(F.lit("-"), x["n"])))
    return F.concat(F.array_join(pieces, ""), F.substr(s, F.coalesce(F.get(r, F.size(r) - 1)["at"], F.lit(0)) + 1))


def ungapped(seq: str | Column) -> Column:
    return F.replace(_c(seq), F.lit("-"), F.lit(""))
