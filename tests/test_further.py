"""Golden values and edge cases of cursors, bit sets, schemes, splittable files and sinks."""

import pytest
from pyspark.sql import functions as F

from seqframe.alphabet import alphabet
from seqframe.functions import bitset as B
from seqframe.functions import letters as L
from seqframe.functions import sam as S
from seqframe.kernels.align import affine_all
from seqframe.operators import alignments as A
from seqframe.operators.cursors import Cursors
from seqframe.sources import files
from seqframe.sources import text as T


def labels(c):
    return {r.cursor_id: (r.label, r.moved) for r in c.table.collect()}


def test_cursors(spark):
    refs = spark.createDataFrame([(0, "AACGATCG"), (1, "CGA"), (2, None), (3, "")], "reference_id int, text string")
    ids = spark.createDataFrame([(0,)], "cursor_id int")
    root = Cursors.root(ids, refs)
    a = root.extend_right("CG")
    assert labels(a) == {0: ("CG", True)}
    assert a.count().first().n == 3
    assert sorted((r.reference_id, r.reference_begin_position) for r in a.locate().collect()) == [(0, 2), (0, 6), (1, 0)]
    assert labels(a.extend_right("T")) == {0: ("CG", False)}
    assert labels(a.extend_right()) == {0: ("CGA", True)}
    assert labels(a.extend_left()) == {0: ("ACG", True)}
    assert labels(a.extend_left().cycle_front()) == {0: ("TCG", True)}
    assert labels(root.extend_right()) == {0: ("A", True)}
    assert labels(root.extend_right().cycle_back().cycle_back().cycle_back().cycle_back()) == {0: ("T", False)}
    assert labels(root.cycle_back()) == {0: ("", False)}
    assert a.path("dna4").first().asDict() == {"cursor_id": 0, "label": "CG", "query_length": 2, "last_rank": 2}
    assert a.reversed().count().first().n == 3 and labels(a.reversed()) == {0: ("GC", True)}
    with pytest.raises(ValueError):
        Cursors.root(ids, refs.where("text = ''"))


def test_bit_sets(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    places = lambda *p: B.of_places(F.lit(list(p)).cast("array<int>") if p else F.array().cast("array<int>"), 130)
    assert row(B.places(places(0, 63, 64, 129))) == [0, 63, 64, 129]
    assert row(B.places(B.reset(B.set_(places(), 63), 63))) == []
    assert row(B.places(B.flip(places(5), 127))) == [5, 127]
    assert row(B.all_(B.not_(places(), 130), 130)) and row(B.none(places())) and row(B.any_(places(129)))
    assert row(B.places(B.shift(places(0, 129), -1, 130))) == [128]
    for bad in (places(130), B.and_(places(), B.of_places(F.array(F.lit(1)), 64))):
        with pytest.raises(Exception):
            row(bad)


def test_chunks_and_gaps(spark):
    df = spark.createDataFrame([("aab--c", 3), ("", 0), (None, None), ("---", 0)], "s string, i int")
    assert [r.x for r in df.select(L.chunk_by("s", lambda a, b: a == b).alias("x")).collect()] == [["aa", "b", "--", "c"], [], None, ["---"]]
    again = df.select("s", A.with_gap_runs(A.ungapped("s"), A.gap_runs("s")).alias("x"), A.insert_gap("s", F.col("i"), 2).alias("y"))
    assert all(r.s == r.x for r in again.collect())
    assert again.first().y == "aab----c"
    with pytest.raises(Exception):
        df.select(L.take_until_or_throw("s", "z")).collect()
    with pytest.raises(Exception):
        df.select(L.convert("s", "dna4", "rna4")).collect()


def test_schemes():
    text = "# c\n  A R X\nA 4 -1 0\nR -1 5 -1\nX 0 -1 -1\n"
    scheme = A.scheme_of(A.scheme_text(A.aminoacid_scheme(text)))
    score = A.AlignConfig(scheme=scheme).score_of()
    assert (score("A", "A"), score("a", "r"), score("W", "R"), score("*", "?")) == (4, -1, -1, -1)
    nucleotide = A.AlignConfig(scheme=A.nucleotide_scheme(4, -5)).score_of()
    assert (nucleotide("u", "T"), nucleotide("?", "N"), nucleotide("A", "C")) == (4, 4, -5)
    assert affine_all([("ACGU", "acgt")], nucleotide, 0, -1)[0].score == 16
    own = {(p, q): 1 if p == q else 0 for p in alphabet("dna15").letters for q in alphabet("dna15").letters}
    assert A.AlignConfig(scheme=A.nucleotide_scheme(matrix=own)).score_of()("A", "A") == 1
    with pytest.raises(ValueError):
        A.nucleotide_scheme(200)


def test_tags(spark):
    with pytest.raises(ValueError):
        S.register_tag("NM", "Z")
    with pytest.raises(ValueError):
        S.register_tag("1X", "i")
    S.register_tag("XQ", "f")
    t = spark.createDataFrame([(["XQ:f:1.5", "NM:i:3", "TS:A:+"],)], "f array<string>").select(S.parse_tags("f").alias("t"))
    assert t.select(S.tag_value("t", "XQ"), S.tag_value("t", "NM"), S.tag_value("t", "TS"), S.tag_value("t", "ZZ")).first()[:] == (1.5, 3, "+", None)


def test_fastq_split(spark, tmp_path):
    """Every cut of a file gives the same records, also where qualities begin with @ or +."""
    want = [(f"r{i}", "ACGT"[i % 4] * (i % 7 + 1), "@+"[i % 2] * (i % 7 + 1)) for i in range(16)]
    (tmp_path / "x.fq").write_text("\n".join(T.write_fastq(iter(want))) + "\n")
    (tmp_path / "y.fq").write_text("")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (7, 23, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted(tuple(r) for r in files.read_fastq_split(spark, str(tmp_path / "*.fq")).collect()) == sorted(want)
        (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n@b\nACGT\n+\nII\n")
        with pytest.raises(Exception):
            files.read_fastq_split(spark, str(tmp_path / "x.fq")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_bam_sink(spark, tmp_path):
    lines = [f"r{i}\t0\tref\t{i + 1}\t9\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:{i}" for i in range(20_000)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "sam"))
    sam = files.read_sam(spark, str(tmp_path / "sam"))
    files.write_bam(sam.repartition(3), str(tmp_path / "bam"), [("ref", 30_000), ("other", 5)])
    assert sorted(p.name for p in (tmp_path / "bam").iterdir()) == [f"part-{i:05d}.bam" for i in range(3)]
    assert sorted(r.value for r in files.sam_lines(files.read_bam(spark, str(tmp_path / "bam"))).collect()) == sorted(lines)
    assert sorted(r.value for r in files.sam_lines(files.read_bam(spark, str(tmp_path / "bam"), large=True)).collect()) == sorted(lines)
    assert [x["SN"] for x in files.bam_header(spark, str(tmp_path / "bam"))["SQ"]] == ["ref", "other"]
    for write in (files.write_bam, files.write_sam):
        with pytest.raises(Exception):
            write(sam, str(tmp_path / write.__name__), [("unknown", 5)])
        assert not list((tmp_path / write.__name__).glob("part-*"))


def test_pieces_of_bam():
    """A file that comes in pieces of any size gives the same lines; one cut short raises an error."""
    refs, lines = [("a" * 30, 9), ("b", 5)], [f"r{i}\t0\tb\t{i + 1}\t9\t4M\t=\t3\t0\tACGT\tIIII\tXZ:Z:{'x' * i}" for i in range(40)]
    packed = b"".join(T.write_bam("@HD\tVN:1.6\n", refs, iter(lines)))
    pieces = lambda data, n: iter([data[i : i + n] for i in range(0, len(data), n)])
    want = T.read_bam(T.decompress(packed))[2]
    plain = T.decompress(packed)
    for n in (1, 7, 100, 1 << 20):
        assert list(T.bam_lines(T.inflated(pieces(packed, max(n, 2))))) == want
        assert list(T.bam_lines(pieces(plain, n))) == want
    for short in (plain[:-1], plain[:20], b""):
        with pytest.raises(T.ParseError):
            list(T.bam_lines(pieces(short, 8)))
    with pytest.raises(T.ParseError):
        list(T.inflated(pieces(packed[:100], 50)))


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        files.register_format("fasta", ("x",), "id string", iter)
    with pytest.raises(ValueError):
        files.register_format("mine", ("fa",), "id string", iter)
    (tmp_path / "a.fa").write_text("> a\nACGT\n> b\nGG\n")
    assert [tuple(r) for r in files.read_sequences(spark, str(tmp_path / "a.fa"), fields=("seq", "id")).collect()] == [("ACGT", "a"), ("GG", "b")]
    with pytest.raises(ValueError):
        files.read_sequences(spark, str(tmp_path / "a.fa"), fields=("nothing",))
    (tmp_path / "b.fa").write_text("> a\nAC!T\n")
    with pytest.raises(Exception):
        files.read_fasta_split(spark, str(tmp_path / "b.fa"), "dna").collect()
