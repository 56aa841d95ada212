"""Bit sets of any size as array<bigint> columns of 64-bit words; place 0 is the lowest bit of the first word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqframe.functions.letters import _c

_WORDS = "array<bigint>"


def _last(size: int) -> int:
    """Bits of the last word that belong to the set."""
    rest = size % 64
    return (1 << rest) - 1 if rest else -1


def of_places(places: str | Column, size: int) -> Column:
    """The set of these places of size; a place outside raises an error."""
    p = _c(places)
    n = max(1, -(-size // 64))
    inside = F.forall(p, lambda x: (x >= 0) & (x < size))
    word = lambda w: F.aggregate(F.filter(p, lambda x: F.floor(x / 64) == w), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 64).cast("int"))))
    out = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)
    return F.when(inside, out).when(p.isNotNull(), F.raise_error(F.lit("a place is outside the set")).cast(_WORDS))


def places(words: str | Column) -> Column:
    """array<int> of the places that are set, ascending."""
    w = _c(words)
    every = F.sequence(F.lit(0), F.size(w) * 64 - 1)
    return F.filter(every, lambda i: F.getbit(F.get(w, F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1)


def _zipped(a: str | Column, b: str | Column, how: str) -> Column:
    x, y = _c(a), _c(b)
    out = F.zip_with(x, y, lambda p, q: getattr(p, how)(q))
    return F.when(F.size(x) == F.size(y), out).when(x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("sets of different sizes")).cast(_WORDS))


def and_(a: str | Column, b: str | Column) -> Column:
    return _zipped(a, b, "bitwiseAND")


def or_(a: str | Column, b: str | Column) -> Column:
    return _zipped(a, b, "bitwiseOR")


def xor(a: str | Column, b: str | Column) -> Column:
    return _zipped(a, b, "bitwiseXOR")


def not_(words: str | Column, size: int) -> Column:
    """All places flipped; bits beyond size stay 0."""
    end = F.size(_c(words)) - 1
    return F.transform(_c(words), lambda x, i: F.when(i == end, F.bitwise_not(x).bitwiseAND(F.lit(_last(size)))).otherwise(F.bitwise_not(x)))


def count(words: str | Column) -> Column:
    return F.aggregate(_c(words), F.lit(0), lambda n, x: n + F.bit_count(x))


def any_(words: str | Column) -> Column:
    return F.exists(_c(words), lambda x: x != 0)


def none(words: str | Column) -> Column:
    return ~any_(words)


def all_(words: str | Column, size: int) -> Column:
    return count(words) == size


def test(words: str | Column, place: str | Column) -> Column:
    p = _c(place)
    return F.getbit(F.get(_c(words), F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1


def _at(words: str | Column, place: int, change: str) -> Column:
    bit = (1 << place % 64) - (1 << 64 if place % 64 == 63 else 0)
    other = ~bit if change == "bitwiseAND" else bit
    return F.transform(_c(words), lambda x, i: F.when(i == place // 64, getattr(x, change)(F.lit(other).cast("bigint"))).otherwise(x))


def set_(words: str | Column, place: int) -> Column:
    return _at(words, place, "bitwiseOR")


def reset(words: str | Column, place: int) -> Column:
    return _at(words, place, "bitwiseAND")


def flip(words: str | Column, place: int) -> Column:
    return _at(words, place, "bitwiseXOR")


def shift(words: str | Column, n: int, size: int) -> Column:
    """Every place n further (back, if negative); places beyond either end are lost."""
    return of_places(F.filter(F.transform(places(words), lambda x: x + n), lambda x: (x >= 0) & (x < size)), size)
