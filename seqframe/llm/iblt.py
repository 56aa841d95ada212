"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

The digests of a text's distinct paragraphs (lines) go into three cells each, one in each third of a
table; a cell holds a count, the XOR of its digests and the XOR of their check hashes. Subtracting
the tables of two versions leaves the digests in one of them only. Peeling recovers these: a cell
with a count of one whose check hash fits its digest is pure; its digest leaves its three cells,
which makes others pure.

A fingerprint's size follows from the text alone. Digests are dealt by hash to parts, a power of two
of them with ITEMS digests each at most on average, so the cells to search stay few however long the
texts are, and parts can be folded into half as many by adding their cells. Each part is a table of
CELLS cells, or of twice, four times as many and so on: as many as it takes for the fingerprint to
be peeled as a whole (larger on failure). A fingerprint also names the number of its digests and a
hash of the text, so texts with the same lines in another order differ.

Two fingerprints are compared by themselves, without their texts: the one with more parts is folded,
the tables are subtracted and peeled. If that fails, or the tables differ in size, each fingerprint
is peeled alone, which its size allows, and the two sets of digests are compared.

All of it happens within a row; the only shuffle brings a text to the text before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a part's smallest table, its digests on average at most, and how often a table's size may double.
CELLS, ITEMS, DOUBLINGS = 48, 12, 8
CELL = "struct<n: int, key: bigint, chk: bigint>"


def paragraphs(text: Column) -> Column:
    """Digests (long) of the distinct lines of a text that aren't empty."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _cell(digest: Column, t: int, third: Column) -> Column:
    """The digest's cell in the t-th of three thirds of so many cells."""
    return F.pmod(F.xxhash64(digest, F.lit(t)), third).cast("int") + t * third


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(77))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the lambda's variable is a local name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def table(digests: Column, third: Column) -> Column:
    """array<struct<n, key, chk>> of the digests, with three times so many cells."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))
    items = F.transform(digests, lambda d: F.struct(d.alias("key"), _check(d).alias("chk"), F.array(*(_cell(d, t, third) for t in range(3))).alias("at")))

    def built(own: Column) -> Column:
        def place(i: Column) -> Column:
            here = F.filter(own, lambda x: F.get(x["at"], F.floor(i / third).cast("int")) == i)
            return F.aggregate(here, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), a["key"].bitwiseXOR(x["key"]).alias("key"), a["chk"].bitwiseXOR(x["chk"]).alias("chk")))

        return F.transform(_upto(3 * third), place)

    return _let(items, built)


def deal(digests: Column) -> Column:
    """array<array<long>>: the digests by part. They are dealt to about the root of the parts first, then each of those on."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.size(digests) / ITEMS))).cast("int")
    part = lambda d: F.xxhash64(d, F.lit(9))

    def dealt(own: Column, k: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1), F.floor(k / 2).cast("int"))
        high = F.call_function("shiftleft", F.lit(1), k - F.floor(k / 2).cast("int"))

        def on(n: Column, m: Column) -> Column:
            first = lambda i: F.filter(own, lambda d: F.pmod(part(d), n) == i)
            second = lambda some: F.transform(_upto(m), lambda j: F.filter(some, lambda d: F.floor(F.pmod(part(d), n * m) / n) == j))
            flat = F.flatten(F.transform(_upto(n), lambda i: _let(first(i), second)))
            return _let(flat, lambda all_: F.transform(_upto(n * m), lambda p: F.get(all_, (p % n) * m + F.floor(p / n).cast("int"))))

        return _let(low, lambda n: _let(high, lambda m: on(n, m)))

    return _let(digests, lambda own: _let(bits, lambda k: dealt(own, k)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")))


def peel(difference: Column, third: Column, rounds: int = 24) -> Column:
    """Digests (array<long>) that a subtracted table holds, or null if some can't be recovered."""
    start = F.struct(difference.alias("cells"), F.array().cast("array<long>").alias("found"), F.lit(True).alias("live"))

    def without(c: Column, i: Column, gone: Column) -> Column:
        here = F.filter(gone, lambda p: F.array_contains(p["at"], i))
        return F.aggregate(here, c, lambda a, p: F.struct((a["n"] - p["n"]).alias("n"), a["key"].bitwiseXOR(p["key"]).alias("key"), a["chk"].bitwiseXOR(p["chk"]).alias("chk")))

    def turn(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["chk"]))
        places = F.array_distinct(F.transform(pure, lambda p: F.struct(p["key"].alias("key"), p["chk"].alias("chk"), p["n"].alias("n"), F.array(*(_cell(p["key"], t, third) for t in range(3))).alias("at"))))

        def after(gone: Column) -> Column:
            state = F.struct(F.transform(acc["cells"], lambda c, i: without(c, i, gone)).alias("cells"), F.concat(acc["found"], F.transform(gone, lambda p: p["key"])).alias("found"), F.lit(True).alias("live"))
            ended = F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("live"))
            return F.when(F.size(gone) > 0, state).otherwise(ended)

        return F.when(acc["live"], _let(places, after)).otherwise(acc)

    clean = lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda a: F.when(F.forall(a["cells"], clean), a["found"]))


def decode(parts: Column, cells: Column) -> Column:
    """Digests of a fingerprint's or a difference's parts of so many cells, or null if some can't be recovered."""
    found = F.transform(parts, lambda t: peel(t, F.floor(cells / 3).cast("int")))
    return _let(found, lambda x: F.when(F.forall(x, lambda y: y.isNotNull()), F.flatten(x)))


def sketch(text: Column) -> Column:
    """struct<n, cells, text, parts>: number of digests, cells of a part, hash of the text, tables."""

    def of(own: Column) -> Column:
        none = F.struct(F.lit(None).cast("int").alias("cells"), F.lit(None).cast(f"array<array<{CELL}>>").alias("parts"))

        def larger(parts: Column, cells: Column) -> Column:
            tables = F.transform(parts, lambda d: table(d, F.floor(cells / 3).cast("int")))
            return _let(tables, lambda t: F.when((cells == CELLS << DOUBLINGS) | decode(t, cells).isNotNull(), F.struct(cells.alias("cells"), t.alias("parts"))).otherwise(none))

        sizes = F.array(*(F.lit(CELLS << i) for i in range(DOUBLINGS + 1)))
        made = _let(deal(own), lambda parts: F.aggregate(sizes, none, lambda a, cells: F.when(a["cells"].isNull(), larger(parts, cells)).otherwise(a)))
        return _let(made, lambda m: F.struct(F.size(own).alias("n"), m["cells"].alias("cells"), F.xxhash64(text).alias("text"), m["parts"].alias("parts")))

    return _let(paragraphs(text), of)


def serialise(own: Column) -> Column:
    """Text form of a sketch: number, cells and text hash, then the parts; count, key and check of every cell in hexadecimal, a dash if empty."""
    cell = lambda c: F.when(c["n"] == 0, "-").otherwise(F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["chk"])))
    parts = F.array_join(F.transform(own["parts"], lambda t: F.array_join(F.transform(t, cell), ",")), "/")
    return F.concat_ws(":", own["n"].cast("string"), own["cells"].cast("string"), F.hex(own["text"]), parts)


def parse(fingerprint: Column) -> Column:
    """The sketch of its text form."""
    signed = lambda x: F.conv(x, 16, -10).cast("long")

    def cell(x: Column) -> Column:
        some = F.split(x, "[.]")
        full = F.struct(signed(F.get(some, F.lit(0))).cast("int").alias("n"), signed(F.get(some, F.lit(1))).alias("key"), signed(F.get(some, F.lit(2))).alias("chk"))
        return F.when(x == "-", F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))).otherwise(full)

    def of(x: Column) -> Column:
        parts = F.transform(F.split(F.get(x, F.lit(3)), "/"), lambda t: F.transform(F.split(t, ","), cell))
        return F.struct(F.get(x, F.lit(0)).cast("int").alias("n"), F.get(x, F.lit(1)).cast("int").alias("cells"), signed(F.get(x, F.lit(2))).alias("text"), parts.alias("parts"))

    return _let(F.split(fingerprint, ":"), of)


def fold(parts: Column, n: Column) -> Column:
    """As many parts as n, a smaller power of two: each is the sum of those that share its number modulo n."""
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")))

    def of(i: Column) -> Column:
        return F.aggregate(F.sequence(i + n, F.size(parts) - 1, n), F.get(parts, i), lambda a, j: add(a, F.get(parts, j)))

    return F.when(F.size(parts) == n, parts).otherwise(F.transform(_upto(n), of))


def differing(own: Column, other: Column) -> Column:
    """How many digests are in one of two sketches only, found by peeling; null if that fails at the largest size."""

    def subtracted(n: Column) -> Column:
        return F.zip_with(fold(own["parts"], n), fold(other["parts"], n), subtract)

    least = F.least(F.size(own["parts"]), F.size(other["parts"]))
    together = F.when(own["cells"] == other["cells"], F.array_size(decode(_let(least, subtracted), own["cells"])))
    both = F.array(decode(own["parts"], own["cells"]), decode(other["parts"], other["cells"]))
    apart = _let(both, lambda x: F.size(F.array_except(F.get(x, F.lit(0)), F.get(x, F.lit(1)))) + F.size(F.array_except(F.get(x, F.lit(1)), F.get(x, F.lit(0)))))
    return F.coalesce(together, F.when(apart >= 0, apart))


def likeness(own: Column, other: Column) -> Column:
    """Shared over all digests of two sketches, from 0 to 1; two without digests are alike."""

    def of(a: Column, b: Column) -> Column:
        total = a["n"] + b["n"]
        return _let(F.coalesce(differing(a, b), total), lambda d: F.when(total == 0, 1.0).otherwise((total - d) / (total + d)))

    return _let(own, lambda a: _let(other, lambda b: of(a, b)))


def with_next(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """range, doc_id, text, next_text: each row with the text of the row after it in descending doc_id, the last with the first's.

    Texts are shuffled once, by ranges of doc_id whose bounds are its approximate quantiles; an
    identifier that several quantiles share (or null) has as many ranges, by a hash of the text. The
    first row of a range is also sent to the range before, where it only serves as a next row. The
    driver holds a bound and a first identifier for each range. Rows of equal doc_id follow in the
    order of a hash of their texts; a null doc_id comes last. Null texts count as empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = rows.withColumn("key", key).withColumn("h", F.xxhash64("text"))
    n = buckets_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [int(x) for x in rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) or []]
    bounds = sorted(set(quantiles))
    limits = F.array(*(F.lit(x) for x in bounds)) if bounds else F.array().cast("array<long>")
    shares = F.array(*(F.lit(quantiles.count(x)) for x in bounds), F.lit(1))
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length(), -1, -1)))
    # how many bounds are below the key, by binary search
    rows = rows.withColumn("place", F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(limits, at + s - 1) < F.col("key")), at + s).otherwise(at)))
    share = F.when(F.get(limits, F.col("place")) == F.col("key"), F.get(shares, F.col("place"))).otherwise(1)
    part = F.least(F.floor(share * (F.lit(0.5) - F.col("h") / F.lit(2.0**64))), share - 1)
    rows = rows.withColumn("range", F.col("place").cast("long") * (n + 1) + part).drop("place")
    first = F.struct("key", F.bitwise_not("h").alias("h"))
    heads = {r.range: r.head for r in rows.groupBy("range").agg(F.max(first).alias("head")).collect()}
    order = sorted(heads)
    before = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}  # the range whose last row comes before this range's first
    of = spark.createDataFrame([(r, heads[r], before[r]) for r in order], "range long, head struct<key: long, h: long>, before long")
    rows = rows.join(F.broadcast(of), "range")
    own, extra = F.struct(F.col("range").alias("r"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("r"), F.lit(1).alias("extra"))
    rows = rows.withColumn("to", F.explode(F.when(first == F.col("head"), F.array(own, extra)).otherwise(F.array(own))))
    rows = rows.select(F.col("to.r").alias("range"), F.col("to.extra").alias("extra"), "doc_id", "text", "h")
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "h")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("extra = 0").drop("extra", "h")


def edits(rows: DataFrame) -> DataFrame:
    """rows with n_chars and edited: the last half of the code points (rounded down) replaced by as many of next_text's first."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    near_edited and near_next are likenesses of the fingerprints: likeness(parse(a), parse(b)) gives
    them from their text forms. Null and empty texts have no paragraph and empty cells, texts of any
    length are taken whole. Repeated rows each count, equal texts have equal fingerprints, and a
    single row is its own next. Further columns are ignored; an empty table gives an empty result.
    """
    rows = edits(with_next(docs))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("new"), sketch(F.col("next_text")).alias("next"))
    # each sketch is used several times: an exploded array keeps the optimizer from computing it again for each use
    rows = rows.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct("own", "new", "next"))).alias("s"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        serialise(F.col("s.own")).alias("fingerprint"),
        serialise(F.col("s.new")).alias("edited_fingerprint"),
        likeness(F.col("s.own"), F.col("s.new")).alias("near_edited"),
        likeness(F.col("s.own"), F.col("s.next")).alias("near_next"),
    )
