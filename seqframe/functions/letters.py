"""Letters and sequences: conversion, complement, translation, qualities, slices, character classes.

Every function takes and returns Columns and stays within Spark's own expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqframe.alphabet import PHRED, Alphabet, alphabet, codons


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _set(chars: str) -> str:
    return "".join("\\" + c if c in r"\]^-[&" else c for c in chars)


def char_to(seq: str | Column, to: str | Alphabet) -> Column:
    """Characters to letters of an alphabet; unknown ones become its default letter."""
    a = alphabet(to)
    m = a.mapping
    known = F.regexp_replace(_c(seq), f"[^{_set(''.join(m))}]", re.sub(r"([$\\])", r"\\\1", a.default))
    moved = {k: v for k, v in m.items() if k != v}
    return F.translate(known, "".join(moved), "".join(moved.values())) if moved else known


def char_is_valid_for(seq: str | Column, to: str | Alphabet) -> Column:
    """Whether every character stands for a letter of its own (lower case counts where the alphabet takes it)."""
    a = alphabet(to)
    fine = "".join(c for c, v in a.mapping.items() if c == v or c.upper() == v or (a.complement and {c.upper(), v} == {"T", "U"}))
    return _c(seq).rlike(f"^[{_set(fine)}]*$")


def validate_char_for(seq: str | Column, to: str | Alphabet) -> Column:
    """The sequence itself; an invalid character raises an error."""
    return F.when(char_is_valid_for(seq, to), _c(seq)).when(_c(seq).isNotNull(), F.raise_error(F.concat(F.lit(f"not a valid {alphabet(to).name} sequence: "), _c(seq))).cast("string"))


def char_strictly_to(seq: str | Column, to: str | Alphabet) -> Column:
    return char_to(validate_char_for(seq, to), to)


def to_char(seq: str | Column) -> Column:
    return _c(seq)


def to_rank(seq: str | Column, of: str | Alphabet) -> Column:
    """array<int> of ranks."""
    letters = F.lit(alphabet(of).letters)
    chars = F.filter(F.split(_c(seq), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(letters, c) - 1)


def rank_to(ranks: str | Column, of: str | Alphabet) -> Column:
    letters = F.lit(alphabet(of).letters)
    return F.array_join(F.transform(_c(ranks), lambda r: F.substr(letters, r + 1, F.lit(1))), "")


def complement(seq: str | Column, of: str | Alphabet = "dna15") -> Column:
    a = alphabet(of)
    if not a.complement:
        raise ValueError(f"{a.name} has no complement")
    return F.translate(_c(seq), a.letters, a.complement)


def reverse_complement(seq: str | Column, of: str | Alphabet = "dna15") -> Column:
    return F.reverse(complement(seq, of))


def translate_triplet(n1: str | Column, n2: str | Column, n3: str | Column) -> Column:
    return _amino(_dna(F.concat(_c(n1), _c(n2), _c(n3))))


def _dna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "U", "T")


def _amino(codon: Column) -> Column:
    """Amino acid of a DNA codon in upper case: the place of each base in TCAG selects a letter of the genetic code; other codes by their common amino acid."""
    table = codons()
    order = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    code = F.lit("".join(table[x] for x in order))
    at = [F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    plain = F.substr(code, (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2], F.lit(1))
    wide = {k: v for k, v in codons("ABCDGHKMNRSTVWY").items() if v != "X" and set(k) - set("ACGT")}
    rare = F.coalesce(F.element_at(F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in wide.items())), F.lit(","), F.lit(":")), codon), F.lit("X"))
    return F.when((at[0] > 0) & (at[1] > 0) & (at[2] > 0), plain).otherwise(rare)


def translate_single(seq: str | Column, frame: int = 0, reverse: bool = False) -> Column:
    """One reading frame of a nucleotide sequence; letters short of a codon at the end are left out.

    The codons come from one pass of a pattern over the sequence, so the work grows with its length.
    """
    s = F.reverse(complement(_dna(_c(seq)))) if reverse else _dna(_c(seq))
    return F.array_join(F.transform(F.regexp_extract_all(F.substr(s, F.lit(frame + 1)), F.lit("(?s)..."), F.lit(0)), _amino), "")


def translate(seq: str | Column, frames: tuple[str, ...] = ("f0", "f1", "f2", "r0", "r1", "r2")) -> Column:
    """array<string> of the frames asked for, in the order f0 f1 f2 r0 r1 r2."""
    order = [f for f in ("f0", "f1", "f2", "r0", "r1", "r2") if f in frames]
    return F.array(*(translate_single(seq, int(f[1]), f[0] == "r") for f in order))


def translate_join(seq: str | Column, frames: tuple[str, ...] = ("f0", "f1", "f2", "r0", "r1", "r2")) -> Column:
    """A generator: one row for each frame of each sequence."""
    return F.explode(translate(seq, frames))


def trim_quality(qual: str | Column, threshold: int) -> Column:
    """The longest prefix whose scores all reach the threshold."""
    return F.regexp_extract(_c(qual), f"^[{_set(chr(33 + threshold))}-~]*", 0)


def to_phred(qual: str | Column, of: str = "phred42") -> Column:
    """array<int> of scores, clamped to the alphabet."""
    low, high, zero = PHRED[of]
    return F.transform(F.filter(F.split(_c(qual), ""), lambda c: c != ""), lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.ascii(c) - zero)))


def assign_phred_to(scores: str | Column, of: str = "phred42") -> Column:
    low, high, zero = PHRED[of]
    return F.array_join(F.transform(_c(scores), lambda s: F.chr(F.greatest(F.lit(low), F.least(F.lit(high), s)) + zero)), "")


def convert_quality(qual: str | Column, source: str, target: str) -> Column:
    return assign_phred_to(to_phred(qual, source), target)


def convert(seq: str | Column, source: str | Alphabet, target: str | Alphabet) -> Column:
    """Letters of one alphabet as those of another; what isn't a letter of the source raises an error."""
    return char_to(char_strictly_to(seq, source), target)


def rank_key(seq: str | Column, of: str | Alphabet) -> Column:
    """A text that sorts as the sequence does by the ranks of its letters."""
    a = alphabet(of)
    return F.translate(char_to(seq, a), a.letters, "".join(chr(0x21 + i) for i in range(a.size)))


def elements(col: str | Column, name: str) -> Column:
    return _c(col).getField(name)


def slice_(seq: str | Column, begin: int, end: int) -> Column:
    """Letters begin to end, half open, clamped to the sequence."""
    if end < begin:
        raise ValueError("a slice ends before it begins")
    return F.substring(_c(seq), begin + 1, end - begin)


def interleave(seq: str | Column, step: int, inserted: str) -> Column:
    """inserted after every step letters, but not at the end."""
    return F.regexp_replace(_c(seq), f"(?s)(.{{{step}}})(?=.)", "$1" + re.sub(r"([$\\])", r"\\\1", inserted))


def chunk(seq: str | Column, n: int) -> Column:
    """array<string> of blocks of n letters; the last may be shorter."""
    return F.regexp_extract_all(_c(seq), F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def chunk_by(seq: str | Column, together: Callable[[Column, Column], Column]) -> Column:
    """array<string>: a new block begins wherever together(letter, next letter) is false."""
    s = _c(seq)
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(letters)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~together(F.get(letters, i - 1), F.get(letters, i)))
    cut = F.transform(begins, lambda b, j: F.array_join(F.slice(letters, b + 1, F.coalesce(F.get(begins, j + 1), n) - b), ""))
    return F.when(n > 0, cut).when(s.isNotNull(), F.array().cast("array<string>"))


def join_with(parts: str | Column, sep: str) -> Column:
    return F.array_join(_c(parts), sep)


def repeat_n(seq: str | Column, n: int) -> Column:
    return F.array_repeat(_c(seq), n)


def enumerate_(seq: str | Column) -> Column:
    """A generator of (pos, col) rows, one for each letter."""
    return F.posexplode(F.filter(F.split(_c(seq), ""), lambda c: c != ""))


def take_until(seq: str | Column, stop: str) -> Column:
    """Letters before the first one of stop."""
    return F.regexp_extract(_c(seq), f"^[^{_set(stop)}]*", 0)


def take_until_or_throw(seq: str | Column, stop: str) -> Column:
    """As take_until, but a sequence without a letter of stop raises an error."""
    return F.when(_c(seq).rlike(f"[{_set(stop)}]"), take_until(seq, stop)).when(_c(seq).isNotNull(), F.raise_error(F.lit("reached end of input before the stop")).cast("string"))


def rest_after(seq: str | Column, stop: str) -> Column:
    """What follows the letters before stop and the whole run of letters of stop: the input that a consuming take_until leaves."""
    return F.regexp_replace(_c(seq), f"^[^{_set(stop)}]*[{_set(stop)}]*", "")


def take_line(text: str | Column) -> Column:
    return F.regexp_extract(_c(text), r"^[^\r\n]*", 0)


def take_exactly(seq: str | Column, n: int) -> Column:
    """n letters; a shorter sequence raises an error."""
    return F.when(F.length(_c(seq)) >= n, F.substring(_c(seq), 1, n)).otherwise(F.raise_error(F.lit("reached end of input before the exact number of elements")).cast("string"))


def sequence_hash(seq: str | Column, of: str | Alphabet) -> Column:
    """Base-size number of the ranks of a whole sequence (bigint; sequences that fit only)."""
    return F.aggregate(to_rank(seq, of), F.lit(0).cast("bigint"), lambda h, r: h * alphabet(of).size + r)


def to_lower(seq: str | Column) -> Column:
    return F.translate(_c(seq), "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))


def to_upper(seq: str | Column) -> Column:
    return F.translate(_c(seq), "".join(map(chr, range(97, 123))), "".join(map(chr, range(65, 91))))


#: Character classes: ASCII only.
CLASSES = {
    "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "space": r"\t-\r ", "blank": r"\t ", "graph": r"\x21-\x7E", "punct": r"!-/:-@\[-`{-~",
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "upper": "A-Z", "lower": "a-z", "digit": "0-9", "xdigit": "0-9A-Fa-f",
}


def is_class(char: str | Column, *names: str, negate: bool = False) -> Column:
    """Whether a character is in one of the classes, or with negate in none."""
    found = _c(char).rlike(f"^[{''.join(CLASSES[n] for n in names)}]$")
    return ~found if negate else found


def is_in_interval(char: str | Column, first: str, last: str) -> Column:
    return _c(char).between(first, last) & (F.length(_c(char)) == 1)


def is_char(char: str | Column, *which: str) -> Column:
    return _c(char).isin(*which)


def is_eof(char: str | Column) -> Column:
    return _c(char).isNull()


def floor_log2(n: str | Column) -> Column:
    """Place of the highest bit; needs n > 0."""
    return F.length(F.bin(_c(n).cast("bigint"))) - 1


def ceil_log2(n: str | Column) -> Column:
    return F.when(_c(n) == 1, 0).otherwise(floor_log2(_c(n) - 1) + 1)


def int_pow(base: str | Column, exponent: int) -> Column:
    """Integer power; ANSI arithmetic raises an error on overflow."""
    out = F.lit(1).cast("bigint")
    for _ in range(exponent):
        out = out * _c(base).cast("bigint")
    return out


def bits(x: str | Column) -> dict[str, Column]:
    """count, all, any, none of the bits of a bigint taken as a set; & | ^ ~ and shifts are Spark's own operators."""
    n = F.bit_count(_c(x))
    return {"count": n, "all": n == 64, "any": n > 0, "none": n == 0, "flip": F.bitwise_not(_c(x))}


def bit_test(x: str | Column, place: int) -> Column:
    return F.getbit(_c(x), F.lit(place)) == 1


def mask(seq: str | Column) -> Column:
    """array<boolean>: lower case letters are masked."""
    return F.transform(F.filter(F.split(_c(seq), ""), lambda c: c != ""), lambda c: c != F.upper(c))


def record_filter(min_length: int = 0, min_mean_quality: float = 0.0, seq: str = "seq", qual: str = "qual") -> Column:
    """Condition on records: length and mean quality; a record without qualities passes on its length."""
    scores = to_phred(qual, "phred94")
    mean = F.aggregate(scores, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(scores))
    return (F.length(seq) >= min_length) & F.coalesce(mean >= min_mean_quality, F.lit(True))
