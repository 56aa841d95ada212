"""CIGAR strings, flags and tags of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqframe.functions.letters import _c

#: The bits of a record's flag.
FLAGS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "on_reverse_strand": 0x10, "mate_on_reverse_strand": 0x20,
    "first_in_pair": 0x40, "second_in_pair": 0x80, "secondary_alignment": 0x100, "failed_filter": 0x200, "duplicate": 0x400, "supplementary_alignment": 0x800,
}


def parse_cigar(cigar: str | Column) -> Column:
    """array<struct<count, op>>; * is empty, anything that isn't a CIGAR raises an error."""
    c = _c(cigar)
    counts = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    out = F.zip_with(counts, ops, lambda n, o: F.struct(n.cast("int").alias("count"), o.alias("op")))
    empty = F.array().cast("array<struct<count:int,op:string>>")
    return F.when(c == "*", empty).when(c.rlike(r"^(\d+[MIDNSHP=X])+$"), out).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a CIGAR string: "), c)).cast("array<struct<count:int,op:string>>"))


def cigar_string(cigar: str | Column) -> Column:
    c = _c(cigar)
    return F.when(F.size(c) == 0, "*").otherwise(F.array_join(F.transform(c, lambda x: F.concat(x["count"].cast("string"), x["op"])), ""))


def _consumed(cigar: str | Column, ops: str) -> Column:
    return F.aggregate(_c(cigar), F.lit(0), lambda n, x: n + F.when(F.instr(F.lit(ops), x["op"]) > 0, x["count"]).otherwise(0))


def reference_length(cigar: str | Column) -> Column:
    return _consumed(cigar, "MDN=X")


def query_length(cigar: str | Column, clipped: bool = False) -> Column:
    """Query letters of the alignment; with clipped, also those that are soft-clipped."""
    return _consumed(cigar, "MI=XS" if clipped else "MI=X")


def has_flag(flag: str | Column, *names: str) -> Column:
    bits = sum(FLAGS[n] for n in names)
    return _c(flag).bitwiseAND(F.lit(bits)) == bits


def combine_flags(*names: str) -> int:
    return sum(FLAGS[n] for n in set(names))


TAG_TYPE = "map<string,struct<type:string,value:string>>"


def parse_tags(fields: str | Column) -> Column:
    """map of tag to (type, value) from the optional fields TAG:TYPE:VALUE; a malformed field raises an error."""
    ok = r"^[A-Za-z][A-Za-z0-9]:([AifZ]:.*|H:([0-9A-Fa-f]{2})*|B:[cCsSiIf](,.+)?)$"
    one = lambda f: F.when(f.rlike(ok), F.struct(F.substring(f, 1, 2).alias("tag"), F.struct(F.substring(f, 4, 1).alias("type"), F.substr(f, F.lit(6)).alias("value")).alias("v"))).otherwise(
        F.raise_error(F.concat(F.lit("not a tag: "), f)).cast("struct<tag:string,v:struct<type:string,value:string>>")
    )
    return F.map_from_entries(F.transform(_c(fields), one))


def tag_int(tags: str | Column, tag: str) -> Column:
    return F.element_at(_c(tags), tag)["value"].cast("bigint")


def tag_float(tags: str | Column, tag: str) -> Column:
    return F.element_at(_c(tags), tag)["value"].cast("double")


def tag_string(tags: str | Column, tag: str) -> Column:
    return F.element_at(_c(tags), tag)["value"]


def tag_array(tags: str | Column, tag: str) -> Column:
    """Numbers of an array tag, without its type letter."""
    parts = F.split(F.element_at(_c(tags), tag)["value"], ",")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double"))


def tag_bytes(tags: str | Column, tag: str) -> Column:
    return F.unhex(F.element_at(_c(tags), tag)["value"])


#: The types of the predefined tags that aren't text.
TAG_KINDS = {t: "i" for t in "AM AS CM CP FI H0 H1 H2 HI IH MQ NH NM OP PQ SM TC UQ".split()} | {"CG": "BI", "FZ": "BS", "ML": "BC", "MN": "i", "TS": "A"}
_GETTERS = {"i": tag_int, "f": tag_float, "Z": tag_string, "A": tag_string, "H": tag_bytes, "B": tag_array}


def register_tag(tag: str, kind: str) -> None:
    """Make the type of one's own tag known to tag_value(): A, i, f, Z, H, or B with a letter of the numbers."""
    if len(tag) != 2 or not tag.isascii() or not tag[0].isalpha() or not tag.isalnum() or kind[:1] not in _GETTERS:
        raise ValueError(f"not a tag and its type: {tag} {kind}")
    if TAG_KINDS.get(tag, kind) != kind:
        raise ValueError(f"{tag} has the type {TAG_KINDS[tag]}")
    TAG_KINDS[tag] = kind


def tag_value(tags: str | Column, tag: str) -> Column:
    """The tag's value as a column of its own type; tags of no known type are text."""
    return _GETTERS[TAG_KINDS.get(tag, "Z")[0]](tags, tag)


def tag_strings(tags: str | Column) -> Column:
    """array of TAG:TYPE:VALUE, sorted by tag."""
    return F.transform(F.array_sort(F.map_entries(_c(tags))), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
