"""RNA structure letters and base pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqframe.functions.letters import _c

OPEN, CLOSE = "<([{" + "".join(map(chr, range(65, 91))), ">)]}" + "".join(map(chr, range(97, 123)))


def is_pair_open(letter: str | Column) -> Column:
    return F.instr(F.lit(OPEN), _c(letter)) > 0


def is_pair_close(letter: str | Column) -> Column:
    return F.instr(F.lit(CLOSE), _c(letter)) > 0


def is_unpaired(letter: str | Column) -> Column:
    return ~is_pair_open(letter) & ~is_pair_close(letter)


def pseudoknot_id(letter: str | Column) -> Column:
    """Number of the bracket family, null for an unpaired letter."""
    at = F.greatest(F.instr(F.lit(OPEN), _c(letter)), F.instr(F.lit(CLOSE), _c(letter)))
    return F.when(at > 0, at - 1)


def max_pseudoknot_depth(size: int = 51) -> int:
    return (size - 7) // 2


def _pairs(structures: pd.Series, weights: pd.Series) -> pd.Series:
    def one(s: str | None, w: float) -> list | None:
        if s is None:
            return None
        stacks: dict[int, list[int]] = {}
        out: list[list[dict]] = [[] for _ in s]
        for i, c in enumerate(s):
            if (k := OPEN.find(c)) >= 0:
                stacks.setdefault(k, []).append(i)
            elif (k := CLOSE.find(c)) >= 0:
                if not stacks.get(k):
                    raise ValueError(f"an unpaired closing bracket at {i}")
                j = stacks[k].pop()
                out[i], out[j] = [{"prob": w, "partner": j}], [{"prob": w, "partner": i}]
        if any(stacks.values()):
            raise ValueError("an unpaired opening bracket")
        return out

    return pd.Series([one(s, w) for s, w in zip(structures, weights, strict=True)])


def bpp_from_structure(structure: str | Column, weight: float = 1.0) -> Column:
    """For each letter its partner with the weight as probability; brackets without a partner raise an error."""
    return F.pandas_udf(_pairs, "array<array<struct<prob:double,partner:int>>>")(_c(structure), F.lit(float(weight)))
