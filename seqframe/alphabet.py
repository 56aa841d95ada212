"""Alphabets: named sets of letters over STRING columns, with conversion, rank and complement tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class Alphabet:
    """letters in rank order; fold: other accepted characters and the letter each becomes; default: letter of all others.

    legal: characters that strict conversion accepts. complement: letter by letter, where defined.
    """

    name: str
    letters: str
    default: str
    fold: dict[str, str] = field(default_factory=dict)
    legal: str = ""
    complement: str = ""

    @property
    def size(self) -> int:
        return len(self.letters)

    @property
    def mapping(self) -> dict[str, str]:
        return {c: c for c in self.letters} | self.fold

    def rank(self, letter: str) -> int:
        return self.letters.index(self.mapping.get(letter, self.default))

    @property
    def accepted(self) -> str:
        return self.legal or self.letters


_REGISTRY: dict[str, Alphabet] = {}


def register(a: Alphabet) -> Alphabet:
    """Make an alphabet known by its name; also the way to add one's own."""
    if len(set(a.letters)) != a.size or a.default not in a.letters:
        raise ValueError(f"{a.name}: letters repeat or the default is none of them")
    _REGISTRY[a.name] = a
    return a


def alphabet(name: str | Alphabet) -> Alphabet:
    if isinstance(name, Alphabet):
        return name
    if name not in _REGISTRY:
        raise KeyError(f"unknown alphabet {name!r}")
    return _REGISTRY[name]


def _cased(fold: dict[str, str]) -> dict[str, str]:
    return fold | {k.lower(): v for k, v in fold.items()}


def _both(letters: str, fold: dict[str, str]) -> dict[str, str]:
    """Lower case as upper case, for letters and folded characters."""
    return _cased({c: c for c in letters if c.isalpha()} | fold)


# Which letter an IUPAC code stands for in the smaller nucleotide alphabets.
_TO_DNA4 = {"R": "A", "Y": "C", "S": "C", "W": "A", "K": "G", "M": "A", "B": "C", "D": "A", "H": "A", "V": "A"}
_TO_DNA3BS = {"C": "T", "Y": "T", "S": "T", "B": "T", "R": "A", "W": "A", "M": "A", "D": "A", "H": "A", "V": "A", "K": "G", "U": "T"}
_COMPLEMENT15 = dict(zip("ABCDGHKMNRSTVWY", "TVGHCDMKNYSABWR", strict=True))
# The letter of the reduced amino-acid alphabets that other letters become.
_TO_AA20 = {"B": "D", "J": "L", "O": "L", "U": "C", "X": "S", "Z": "E", "*": "W"}
_TO_MURPHY = {"D": "B", "E": "B", "J": "I", "L": "I", "M": "I", "N": "B", "O": "K", "Q": "B", "R": "K", "T": "S", "U": "C", "V": "I", "W": "F", "X": "S", "Y": "F", "Z": "B", "*": "F"}
_TO_LI = {"D": "B", "E": "B", "L": "J", "M": "J", "N": "H", "O": "K", "Q": "B", "R": "K", "S": "A", "T": "A", "U": "C", "V": "I", "W": "F", "X": "A", "Y": "F", "Z": "B", "*": "F"}
AMINO_LEGAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*"


def _nucleotide(name: str, letters: str, default: str, fold: dict[str, str]) -> Alphabet:
    t = "U" if "U" in letters else "T"
    fold = {k: v.replace("T", t) for k, v in fold.items()} | {"U" if t == "T" else "T": t}
    table = {k.replace("T", t): v.replace("T", t) for k, v in _COMPLEMENT15.items()}
    partner = "".join(c if c not in table else table[c] if table[c] in letters else fold.get(table[c], default) for c in letters)
    return register(Alphabet(name, letters, default, _both(letters, fold), complement=partner))


DNA4 = _nucleotide("dna4", "ACGT", "A", _TO_DNA4)
DNA5 = _nucleotide("dna5", "ACGNT", "N", {})
DNA15 = _nucleotide("dna15", "ABCDGHKMNRSTVWY", "N", {})
RNA4 = _nucleotide("rna4", "ACGU", "A", _TO_DNA4)
RNA5 = _nucleotide("rna5", "ACGNU", "N", {})
RNA15 = _nucleotide("rna15", "ABCDGHKMNRSUVWY", "N", {})
DNA16SAM = _nucleotide("dna16sam", "=ACMGRSVTWYHKDBN", "N", {})
DNA3BS = _nucleotide("dna3bs", "AGT", "A", _TO_DNA3BS)
AA27 = register(Alphabet("aa27", AMINO_LEGAL, "X", _both(AMINO_LEGAL, {})))
AA20 = register(Alphabet("aa20", "ACDEFGHIKLMNPQRSTVWY", "S", _both("ACDEFGHIKLMNPQRSTVWY", _TO_AA20)))
AA10MURPHY = register(Alphabet("aa10murphy", "ABCFGHIKPS", "S", _both("ABCFGHIKPS", _TO_MURPHY)))
AA10LI = register(Alphabet("aa10li", "ABCFGHIJKP", "A", _both("ABCFGHIJKP", _TO_LI)))
DOT_BRACKET3 = register(Alphabet("dot_bracket3", ".()", "."))
DSSP9 = register(Alphabet("dssp9", "HBEGITSCX", "X"))
CIGAR_OP = register(Alphabet("cigar_op", "MDINSHPX=", "M"))
GAP = register(Alphabet("gap", "-", "-"))


def wuss(size: int = 51) -> Alphabet:
    """The WUSS structure alphabet of 15 to 67 letters: seven unpaired ones, then bracket pairs."""
    if size % 2 == 0 or not 15 <= size <= 67:
        raise ValueError("a WUSS alphabet has an odd size from 15 to 67")
    pairs = ["<>", "()", "[]", "{}", *(chr(65 + i) + chr(97 + i) for i in range(26))]
    used = pairs[: (size - 7) // 2]
    return register(Alphabet(f"wuss{size}", ".:,-_~;" + "".join(p[0] for p in used[:4]) + "".join(p[1] for p in used[:4]) + "".join(used[4:]), ";"))


WUSS51 = wuss()

#: Quality alphabets: name -> (least score, greatest score, character of score 0).
PHRED = {"phred42": (0, 41, 33), "phred63": (0, 62, 33), "phred94": (0, 93, 33), "phred68solexa": (-5, 62, 64)}


def gapped(base: str | Alphabet) -> Alphabet:
    a = alphabet(base)
    return register(Alphabet(f"gapped_{a.name}", a.letters + "-", a.default, a.fold, a.legal and a.legal + "-", a.complement and a.complement + "-"))


# Fixed value: the canonical genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The bases that each IUPAC code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def codons(letters: str = "ACGT") -> dict[str, str]:
    """Amino acid of every codon over IUPAC letters: the common one of all codons it stands for, else X."""
    plain = {"".join(c): GENETIC_CODE[i] for i, c in enumerate(product("TCAG", repeat=3))}
    out = {}
    for codon in product(letters, repeat=3):
        found = {plain["".join(c)] for c in product(*(IUPAC[x] for x in codon))}
        out["".join(codon)] = found.pop() if len(found) == 1 else "X"
    return out
