"""Parsing and formatting of record files, without Spark: FASTA, FASTQ, EMBL, GenBank, dot-bracket, SAM, BAM."""

from __future__ import annotations

import bz2
import gzip
import re
import struct
import zlib
from collections.abc import Iterator

from seqframe.alphabet import AMINO_LEGAL


class ParseError(ValueError):
    """A record breaks its format."""


#: Letters allowed in sequences, by traits.
LEGAL = {"dna": set("ACGTURYSWKMBDHVNacgturyswkmbdhvn"), "aa": set(AMINO_LEGAL + AMINO_LEGAL.lower()), "any": None}


def decompress(data: bytes) -> bytes:
    """By magic bytes: gz (also blocked), bz2; zst is refused."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        raise ParseError("zst files aren't supported here")
    return data


#: Bytes of a BGZF block before packing.
BLOCK = 65280


def packed_block(part: bytes) -> bytes:
    """One block of BGZF; of no bytes, the end block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(part) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def blocked_gzip(data: bytes) -> bytes:
    """BGZF: independent blocks of at most 64 KB, and the empty end block."""
    return b"".join(packed_block(data[at : at + BLOCK]) for at in range(0, len(data), BLOCK)) + packed_block(b"")


def _legal(seq: str, traits: str) -> str:
    allowed = LEGAL[traits]
    if allowed is not None and not set(seq) <= allowed:
        raise ParseError(f"illegal letters {sorted(set(seq) - allowed)}")
    return seq


def read_fasta(text: str, traits: str = "dna", truncate_ids: bool = False, ignore_blanks: bool = True) -> Iterator[tuple[str, str, None]]:
    if not text.strip():
        return
    if text.lstrip("\r\n")[:1] not in (">", ";"):
        raise ParseError("an id line begins with > or ;")
    name, parts = None, []
    for line in text.splitlines():
        if line[:1] in (">", ";"):
            if name is not None:
                yield name, _legal("".join(parts), traits), None
            name, parts = line[1:].lstrip(" \t") if ignore_blanks else line[1:], []
            name = name.split(" ")[0] if truncate_ids else name
        else:
            parts.append(re.sub(r"[\s0-9]", "", line))
    if name is not None:
        yield name, _legal("".join(parts), traits), None


def write_fasta(rows: Iterator[tuple[str, str]], width: int = 80, marker: str = ">", blank: bool = True) -> Iterator[str]:
    for name, seq in rows:
        if not name or not seq:
            raise ValueError("a record needs an id and a sequence")
        lines = [seq[i : i + width] for i in range(0, len(seq), width)] if width else [seq]
        yield "\n".join([marker + " " * blank + name, *lines])


def read_fastq(text: str, traits: str = "dna", truncate_ids: bool = False) -> Iterator[tuple[str, str, str]]:
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        if lines[at][0] != "@":
            raise ParseError("an id line begins with @")
        name, at, seq = lines[at][1:], at + 1, ""
        while at < len(lines) and not lines[at].startswith("+"):
            seq += re.sub(r"\s", "", lines[at])
            at += 1
        if at >= len(lines):
            raise ParseError("a record ends before its qualities")
        at, qual = at + 1, ""
        while at < len(lines) and len(qual) < len(seq):
            qual += re.sub(r"\s", "", lines[at])
            at += 1
        if len(qual) != len(seq):
            raise ParseError("as many qualities as letters are needed")
        yield name.split(" ")[0] if truncate_ids else name, _legal(seq, traits), qual


class FastqSplit:
    """Records of four lines from a stretch of a file that may begin and end anywhere.

    A line that begins with @, two lines before one that begins with +, is an id line: sequences
    begin with neither. What precedes the first record and what follows the last are fragments, for
    the records that straddle two stretches.
    """

    def __init__(self, traits: str) -> None:
        self.traits, self.held, self.found, self.head = traits, [], False, []

    def feed(self, lines: list[str]) -> list[tuple[str, str, str]]:
        self.held += [x for x in lines if x.strip()]
        if not self.found:
            at = next((i for i in range(len(self.held) - 2) if self.held[i][0] == "@" and self.held[i + 2][0] == "+"), None)
            if at is None:
                return []
            self.found, self.head, self.held = True, self.held[:at], self.held[at:]
        n = len(self.held) // 4 * 4
        out, self.held = fastq_records(self.held[:n], self.traits), self.held[n:]
        return out

    def fragments(self) -> list[tuple[int, list[str]]]:
        """(whether a new record begins there, lines)."""
        return [(0, self.head), (1, self.held)] if self.found else [(0, self.held)]


def fastq_records(lines: list[str], traits: str) -> list[tuple[str, str, str]]:
    """Records of exactly four lines each."""
    out = []
    if len(lines) % 4:
        raise ParseError("a record ends before its qualities")
    for i in range(0, len(lines), 4):
        name, seq, plus, qual = lines[i : i + 4]
        if name[0] != "@" or plus[0] != "+" or len(seq) != len(qual):
            raise ParseError(f"not a record of four lines: {name[:80]}")
        out.append((name[1:], _legal(seq, traits), qual))
    return out


def write_fastq(rows: Iterator[tuple[str, str, str]], double_id: bool = False) -> Iterator[str]:
    for name, seq, qual in rows:
        if not name or not seq or len(qual or "") != len(seq):
            raise ValueError("a record needs an id, a sequence and as many qualities")
        yield f"@{name}\n{seq}\n+{name if double_id else ''}\n{qual}"


def read_flat(text: str, start: str, origin: str, traits: str = "dna", complete_header: bool = False) -> Iterator[tuple[str, str, None]]:
    """EMBL (ID, SQ) and GenBank (LOCUS, ORIGIN): records end with //."""
    for record in re.split(r"(?m)^//[ \t]*\r?\n?", text):
        if not record.strip():
            continue
        body = record.lstrip("\r\n")
        if not body.startswith(start):
            raise ParseError(f"a record begins with {start}")
        cut = re.search(rf"(?m)^{origin}.*\n?", body)
        if not cut:
            raise ParseError(f"a record has a line {origin}")
        head = body[: cut.start()] if complete_header else re.match(rf"{start}\s+([^;\s]+)", body)[1]
        yield head, _legal(re.sub(r"[\s0-9]", "", body[cut.end() :]), traits), None


def write_embl(rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    for name, seq in rows:
        lines = [f"ID {name}; {len(seq)} BP.", f"SQ Sequence {len(seq)} BP;"]
        for i in range(0, len(seq), 60):
            part = seq[i : i + 60]
            lines.append(" ".join(part[j : j + 10] for j in range(0, len(part), 10)).ljust(66) + str(i + len(part)))
        yield "\n".join([*lines, "//"])


def write_genbank(rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    for name, seq in rows:
        lines = [f"LOCUS       {name}                 {len(seq)} bp", "ORIGIN"]
        for i in range(0, len(seq), 60):
            part = seq[i : i + 60]
            lines.append(str(i + 1).rjust(9) + " " + " ".join(part[j : j + 10] for j in range(0, len(part), 10)))
        yield "\n".join([*lines, "//"])


def read_vienna(text: str) -> Iterator[tuple[str, str, str, float | None]]:
    lines = [x for x in text.splitlines() if x.strip()]
    at = 0
    while at < len(lines):
        name = ""
        if lines[at].startswith(">"):
            name, at = lines[at][1:].strip(), at + 1
        if at + 1 >= len(lines):
            raise ParseError("a record ends before its structure")
        seq = re.sub(r"[\s0-9]", "", lines[at])
        found = re.match(r"(\S+)(?:\s+\(\s*([-+0-9.eE]+)\s*\))?\s*$", lines[at + 1])
        if not found or len(found[1]) != len(seq):
            raise ParseError("the structure's length differs from the sequence's")
        yield name, seq, found[1], float(found[2]) if found[2] else None
        at += 2


def write_vienna(rows: Iterator[tuple[str, str, str, float | None]], precision: int = 6) -> Iterator[str]:
    for name, seq, structure, energy in rows:
        if len(seq) != len(structure):
            raise ValueError("the structure's length differs from the sequence's")
        yield (f"> {name}\n" if name else "") + f"{seq}\n{structure}" + (f" ({energy:.{precision}f})" if energy is not None else "")


def read_header(text: str) -> dict[str, list[dict[str, str]]]:
    """Header lines of an alignment file by their kind: HD, SQ, RG, PG as dictionaries, CO as text."""
    out: dict[str, list[dict[str, str]]] = {k: [] for k in ("HD", "SQ", "RG", "PG", "CO")}
    need = {"HD": ["VN"], "SQ": ["SN", "LN"], "RG": ["ID"], "PG": ["ID"]}
    for line in text.splitlines():
        if not line.startswith("@"):
            break
        kind, _, rest = line[1:].partition("\t")
        if kind == "CO":
            out["CO"].append({"text": rest})
            continue
        if kind not in out:
            raise ParseError(f"an unknown header line @{kind}")
        fields = dict(f.split(":", 1) for f in rest.split("\t") if ":" in f)
        if any(n not in fields for n in need[kind]) or kind == "SQ" and not int(fields["LN"]) > 0:
            raise ParseError(f"@{kind} lacks a field")
        out[kind].append(fields)
    return out


#: Letters of a nibble, operations and array types of a binary alignment file.
NIBBLES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _bam_head(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    if data[:4] != b"BAM\x01":
        raise ParseError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    header, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    count, at = struct.unpack_from("<i", data, at)[0], at + 4
    refs = []
    for _ in range(count):
        k = struct.unpack_from("<i", data, at)[0]
        refs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return header, refs, at


def read_bam_head(data: bytes) -> tuple[str, list[tuple[str, int]]]:
    """(header text, references) of an unpacked binary file."""
    return _bam_head(data)[:2]


def read_bam(data: bytes) -> tuple[str, list[tuple[str, int]], list[str]]:
    """(header text, references, records as SAM lines) of an unpacked binary file."""
    header, refs, at = _bam_head(data)
    lines = []
    while at < len(data):
        line, at = _bam_line(data, at, refs)
        lines.append(line)
    return header, refs, lines


def _bam_line(data: bytes, at: int, refs: list[tuple[str, int]]) -> tuple[str, int]:
    """The record at a place as a SAM line, and the place after it."""
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
    p, end = at + 36, at + 4 + size
    name = data[p : p + l_name - 1].decode()
    p += l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
    p += 4 * n_cigar
    raw = data[p : p + (l_seq + 1) // 2]
    seq = "".join(NIBBLES[x >> 4] + NIBBLES[x & 15] for x in raw)[:l_seq] or "*"
    p += len(raw)
    q = data[p : p + l_seq]
    qual = "*" if not l_seq or q[0] == 255 else "".join(chr(x + 33) for x in q)
    p += l_seq
    tags = []
    while p < end:
        tag, kind = data[p : p + 2].decode(), chr(data[p + 2])
        p += 3
        if kind in "ZH":
            stop = data.index(0, p)
            tags.append(f"{tag}:{kind}:{data[p:stop].decode()}")
            p = stop + 1
        elif kind == "A":
            tags.append(f"{tag}:A:{chr(data[p])}")
            p += 1
        elif kind == "B":
            sub, k = chr(data[p]), struct.unpack_from("<i", data, p + 1)[0]
            form = "<" + str(k) + SCALARS[sub][1]
            tags.append(f"{tag}:B:{sub}" + "".join(f",{x:g}" if sub == "f" else f",{x}" for x in struct.unpack_from(form, data, p + 5)))
            p += 5 + struct.calcsize(form)
        else:
            x = struct.unpack_from(SCALARS[kind], data, p)[0]
            tags.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{x:g}" if kind == "f" else f"{tag}:i:{x}")
            p += struct.calcsize(SCALARS[kind])
    where = refs[ref][0] if ref >= 0 else "*"
    other = "*" if mate < 0 else "=" if mate == ref else refs[mate][0]
    return "\t".join([name or "*", str(flag), where, str(pos + 1), str(mapq), cigar, other, str(mate_pos + 1), str(tlen), seq, qual, *tags]), end


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked bytes of gz members (BGZF blocks too) that come in pieces; anything else as it is."""
    unpack, packed = None, None
    for data in chunks:
        if packed is None:
            packed = data[:2] == b"\x1f\x8b"
        if not packed:
            yield data
            continue
        while data:
            unpack = unpack or zlib.decompressobj(31)
            if out := unpack.decompress(data):
                yield out
            data = unpack.unused_data
            if unpack.eof:
                unpack = None
    if unpack:
        raise ParseError("a packed file ends within a block")


def bam_lines(chunks: Iterator[bytes]) -> Iterator[str]:
    """SAM lines of an unpacked binary file that comes in pieces; no more than a record and a piece are held."""
    held, refs = bytearray(), None
    for part in chunks:
        held += part
        if refs is None:
            if len(held) < 8:
                continue
            try:
                _, refs, at = _bam_head(bytes(held))
            except (struct.error, UnicodeDecodeError):
                continue  # the head goes on in the next piece
            if at > len(held):
                refs = None
                continue
            del held[:at]
        whole, at = bytes(held), 0
        while len(whole) - at >= 4 and len(whole) - at >= 4 + struct.unpack_from("<i", whole, at)[0]:
            line, at = _bam_line(whole, at, refs)
            yield line
        del held[:at]
    if held or refs is None:
        raise ParseError("a binary file ends within a record or its head")


def _bin(begin: int, end: int) -> int:
    """Bin of an interval in the usual scheme of six levels."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def bam_head(header: str, refs: list[tuple[str, int]]) -> bytes:
    """What precedes the records of an unpacked binary file."""
    raw = header.encode()
    out = bytearray(b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs)))
    for name, size in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return bytes(out)


def bam_record(line: str, index: dict[str, int]) -> bytes:
    """A SAM line as a binary record; index: place of each reference."""
    name, flag, ref, pos, mapq, cigar, mate, mate_pos, tlen, seq, qual, *tags = line.split("\t")
    for x in (ref, mate):
        if x not in ("*", "=") and x not in index:
            raise ValueError(f"{x} is not in the header")
    r = index.get(ref, -1)
    m = r if mate == "=" else index.get(mate, -1)
    ops = [] if cigar == "*" else [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    seq, qual = "" if seq == "*" else seq, "" if qual == "*" else qual
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    body = bytearray(struct.pack("<iiBBHHHiiii", r, int(pos) - 1, len(name) + 1, int(mapq), _bin(max(0, int(pos) - 1), max(0, int(pos) - 1) + span), len(ops), int(flag), len(seq), m, int(mate_pos) - 1, int(tlen)))
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops)
    codes = [NIBBLES.index(c) if c in NIBBLES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)
    for tag in tags:
        t, kind, value = tag.split(":", 2)
        body += t.encode() + kind.encode()
        if kind in "ZH":
            body += value.encode() + b"\0"
        elif kind == "A":
            body += value.encode()
        elif kind == "B":
            sub, *values = value.split(",")
            body += sub.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(SCALARS[sub], float(v) if sub == "f" else int(v)) for v in values)
        else:
            body += struct.pack(SCALARS[kind], float(value) if kind == "f" else int(value))
    return struct.pack("<i", len(body)) + bytes(body)


def write_bam(header: str, refs: list[tuple[str, int]], lines: Iterator[str]) -> Iterator[bytes]:
    """BGZF blocks of a binary file of SAM lines, the end block last."""
    index = {name: i for i, (name, _) in enumerate(refs)}
    held = bytearray(bam_head(header, refs))
    for line in lines:
        held += bam_record(line, index)
        while len(held) >= BLOCK:
            yield packed_block(bytes(held[:BLOCK]))
            del held[:BLOCK]
    yield packed_block(bytes(held)) + packed_block(b"")
