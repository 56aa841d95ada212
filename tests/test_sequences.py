import random

import pytest
from pyspark.sql import functions as F

from seqframe.alphabet import alphabet, codons
from seqframe.functions import letters as L
from seqframe.functions import sam as S
from seqframe.functions.structure import bpp_from_structure
from seqframe.kernels import align as A
from seqframe.kernels import sequences as K
from seqframe.kernels.search import SearchConfig, least_errors
from seqframe.operators import filters
from seqframe.operators.filters import BloomFilter, InterleavedBloomFilter
from seqframe.operators.search import search
from seqframe.plans.mapper import map_reads
from seqframe.sources import files
from seqframe.sources import text as T

DNA4 = alphabet("dna4")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def affine(a, b, **o):
    r = A.affine(a, b, lambda p, q: 4 if p == q else -5, -10, -1, **o)
    return r.score, r.aligned1, r.aligned2, (r.begin1, r.begin2), (r.end1, r.end2)


def test_affine():
    assert affine("AACCGGTTAACCGGTT", "ACGTACGTA") == (-18, "AACCGGTTAACCG---GTT", "A----------CGTACGTA", (0, 0), (16, 9))
    assert affine("AACCGGTTTAACCGGTT", "ACGTCTACGTA", local=True) == (11, "GTTTA", "GTCTA", (5, 2), (10, 7))
    assert affine("TTTTTACGTATGTCCCCC", "ACGTAAAACGT", free=(True, True, False, False)) == (10, "ACGT---ATGT", "ACGTAAAACGT", (5, 0), (13, 11))
    assert affine("AACCGGTTAACCGGTT", "ACGTACGTA", band=(-3, 8))[:3] == (-18, "A---ACCGGTTAACCGGTT", "ACGTAC----------GTA")
    with pytest.raises(ValueError):
        affine("AC", "ACGTACGT", band=(0, 1))


def gotoh(a, b, free, local, band):
    """Best score by the plain recursion over cells."""
    low, best = -(10**6), -(10**6)
    h, e, f = {}, {}, {}
    for c in range(len(a) + 1):
        for r in range(len(b) + 1):
            if band and not band[0] <= c - r <= band[1]:
                continue
            e[c, r] = max(h.get((c - 1, r), low) - 11, e.get((c - 1, r), low) - 1)
            f[c, r] = max(h.get((c, r - 1), low) - 11, f.get((c, r - 1), low) - 1)
            start = (c, r) == (0, 0) or local or (r == 0 and free[0]) or (c == 0 and free[2])
            diagonal = h.get((c - 1, r - 1), low) + (4 if c and r and a[c - 1] == b[r - 1] else -5)
            h[c, r] = max(0 if start else low, diagonal, e[c, r], f[c, r])
            if local or (c, r) == (len(a), len(b)) or (free[1] and r == len(b)) or (free[3] and c == len(a)):
                best = max(best, h[c, r])
    return best


def cost(x, y):
    """Score of an aligned pair."""
    out, gap = 0, ""
    for p, q in zip(x, y, strict=True):
        kind = "x" if p == "-" else "y" if q == "-" else ""
        out += (-1 if kind == gap else -11) if kind else 4 if p == q else -5
        gap = kind
    return out


@pytest.mark.parametrize("mode", [{}, {"local": True}, {"free": (True, True, False, False)}, {"free": (False, False, True, True)}, {"free": (True,) * 4}, {"band": (-9, 9)}, {"band": (-2, 3), "free": (True,) * 4}])
def test_batches_of_pairs(mode, monkeypatch):
    """Scores against the plain recursion, aligned parts against the scores, in blocks of several sizes."""
    rng = random.Random(4)
    pairs = [("".join(rng.choices("ACGT", k=rng.randint(0, 9))), "".join(rng.choices("ACGT", k=rng.randint(0, 9)))) for _ in range(150)]
    score = lambda p, q: 4 if p == q else -5
    whole = A.affine_all(pairs, score, -10, -1, **mode)
    for (a, b), r in zip(pairs, whole, strict=True):
        assert r.score == gotoh(a, b, mode.get("free", (False,) * 4), mode.get("local", False), mode.get("band"))
        assert cost(r.aligned1, r.aligned2) == r.score
        assert (r.aligned1.replace("-", ""), r.aligned2.replace("-", "")) == (a[r.begin1 : r.end1], b[r.begin2 : r.end2])
    monkeypatch.setattr(A, "CELLS", 200)
    assert A.affine_all(pairs, score, -10, -1, **mode) == whole


def test_long_query():
    assert least_errors("ACGT" * 1000, 0, "ACGT" * 500 + "A" + "ACGT" * 400, 2, 2, 2, 2) == 1


def test_edit():
    r = A.edit("AACCGGTTAACCGGTT", "ACGTACGTA")
    assert (r.score, r.aligned2) == (-8, "A-C-G-T-A-C-G-TA")
    r = A.edit("AACCGGTAAACCGGTT", "ACGTACGTA", True)
    assert (r.score, r.aligned1, r.aligned2) == (-4, "AC---CGGTA", "ACGTACG-TA")


def test_kmers():
    r = K.ranks("ACGTAGC", DNA4)
    assert K.kmer_hash(r, K.Shape.ungapped(3), 4).tolist() == [6, 27, 44, 50, 9]
    assert K.kmer_hash(r, K.Shape("101"), 4).tolist() == [2, 7, 8, 14, 1]
    assert K.minimiser_hash("ACGGCGACGTTTAG", K.Shape.ungapped(4), 8, 0).tolist() == [26, 97, 27, 6, 1]
    assert K.minimiser_hash("ACGGCGACGTTTAG", K.Shape("1001"), 8, 0).tolist() == [2, 5, 3, 2, 1]
    assert set(K.minimiser_hash("A" * 19, K.Shape.ungapped(4), 8).tolist()) == {0x8F3F73B5CF1C9A21}
    with pytest.raises(ValueError):
        K.Shape("010")


def hits(query, **budget):
    cfg = SearchConfig(**budget)
    text = "ACGTACGTACGT"
    return [p for p in range(len(text) + 1) if least_errors(text, p, query, *cfg.budget(len(query))) is not None]


def test_search_goldens():
    assert hits("ACGT") == [0, 4, 8]
    assert hits("CGG", substitution=1) == [1, 5, 9]
    assert hits("ACGT", insertion=1) == [0, 1, 4, 5, 8, 9]
    assert hits("CCGT", insertion=1) == [1, 5, 9]
    assert hits("ACCGGTAC", insertion=2) == [0, 4]
    assert hits("AGTA", deletion=1) == [0, 4]
    assert hits("AGTAGTAC", deletion=2) == [0]
    assert hits("CCGT", total=1) == [0, 1, 4, 5, 8, 9]
    assert hits("CCGT", total=2) == list(range(11))
    assert hits("CCGT", total=4) == list(range(13))
    assert hits("GTACCTAC", total=2, insertion=2, deletion=2) == [2]


def test_search_join(spark):
    refs = spark.createDataFrame([(0, "ACGTACGTACGT"), (1, None), (2, "")], "reference_id int, text string")
    queries = spark.createDataFrame([(0, "ACGT"), (1, "CCGT"), (2, None)], "query_id int, query string")
    found = {(r.query_id, r.reference_begin_position) for r in search(queries, refs, SearchConfig(total=1), k=2).collect()}
    joined = {(r.query_id, r.reference_begin_position) for r in search(queries, refs, SearchConfig(total=1), k=2, broadcast=-1).collect()}
    lower = search(queries.select("query_id", F.lower("query").alias("query")), refs, SearchConfig(total=1), k=2, alphabet="dna4")
    assert joined == found == {(r.query_id, r.reference_begin_position) for r in lower.collect()}
    assert found == {(q, p) for q in (0, 1) for p in (0, 1, 4, 5, 8, 9)}
    best = {(r.query_id, r.reference_begin_position) for r in search(queries, refs, SearchConfig(total=1, hit="all_best"), k=2).where("query_id = 0").collect()}
    assert best == {(0, 0), (0, 4), (0, 8)}
    assert map_reads(queries.where("query IS NOT NULL"), refs.where("reference_id = 0"), errors=1, k=2).count() > 0


def test_letters(spark):
    assert one(spark, L.translate(F.lit("ACGTACGTACGTA"))) == ["TYVR", "RTYV", "VRT", "YVRT", "TYVR", "RTY"]
    assert one(spark, L.trim_quality(F.lit("II?5+"), 20)) == "II?5"
    assert one(spark, L.char_to(F.lit("acgtunRx"), "dna4")) == "ACGTTAAA"
    assert one(spark, L.char_to(F.lit("ac*x1"), "aa20")) == "ACWSS"
    assert one(spark, L.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, L.to_rank(F.lit("ACGT"), "dna5")) == [0, 1, 2, 4]
    assert one(spark, L.rank_to(L.to_rank(F.lit("ACGT"), "dna5"), "dna5")) == "ACGT"
    assert one(spark, L.chunk(F.lit("ABCDE"), 2)) == ["AB", "CD", "E"]
    assert one(spark, L.interleave(F.lit("ABCDEF"), 2, "-")) == "AB-CD-EF"
    assert one(spark, L.to_phred(F.lit("!I~"), "phred42")) == [0, 40, 41]
    assert codons("ACGTN")["ACN"] == "T"
    with pytest.raises(Exception):
        one(spark, L.char_strictly_to(F.lit("ACX"), "dna4"))


def test_cigar(spark):
    assert [tuple(x) for x in one(spark, S.parse_cigar(F.lit("1S1M1D1M1I")))] == [(1, "S"), (1, "M"), (1, "D"), (1, "M"), (1, "I")]
    assert A.cigar_from_alignment("T-G-A-TC", "T-AGTA-C", 1, 1, extended=True) == [(1, "S"), (1, "="), (1, "P"), (1, "X"), (1, "I"), (1, "X"), (1, "I"), (1, "D"), (1, "="), (1, "S")]
    assert A.alignment_from_cigar([(1, "S"), (1, "M"), (1, "D"), (1, "M"), (1, "I")], "ACTGATCGAGAGGATC", 0, "ACGT") == ("ACT-", "C-GT")


def test_structure(spark):
    pairs = one(spark, bpp_from_structure(F.lit("..(((((..(((...)))..)))))...")))
    assert [p[0].partner for p in pairs if p][:8] == [24, 23, 22, 21, 20, 17, 16, 15]


def test_filters(spark):
    v = spark.range(100).selectExpr("id AS v", "id % 5 AS bin")
    f = BloomFilter.build(v, "v", 1 << 16)
    assert f.count(v, "v").first().n == 100
    i = InterleavedBloomFilter.build(v, "v", "bin", 73, 1019, 3)
    assert i.bit_size == 130432
    assert {r.bin: r.n for r in i.bulk_count(v.where("bin = 3"), "v").collect()}[3] == 20
    assert i.clear(3).table.where("bin = 3").count() == 0


def test_filters_broadcast_or_joined(spark, monkeypatch, tmp_path):
    """The same answers, false positives among them, by lookup and by join; filters saved and loaded."""
    v = spark.range(300).selectExpr("id * 7 AS v", "id % 5 AS bin")
    asked = spark.range(1000).selectExpr("IF(id = 0, NULL, id) AS v")
    f = BloomFilter.build(v, "v", 2011)
    i = InterleavedBloomFilter.build(v, "v", "bin", 73, 509, 2)
    f.save(f"{tmp_path}/f")
    i.save(f"{tmp_path}/i")
    f, i = BloomFilter.load(spark, f"{tmp_path}/f"), InterleavedBloomFilter.load(spark, f"{tmp_path}/i")
    found = []
    for bits in (filters.BITS, 1):
        monkeypatch.setattr(filters, "BITS", bits)
        found.append((sorted(map(str, f.contains(asked, "v").collect())), sorted(map(tuple, i.bulk_contains(asked, "v").collect())), sorted(map(tuple, i.bulk_count(asked, "v").collect()))))
    assert found[0] == found[1] and 143 < f.count(asked, "v").first().n < 400


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("ID1", "ACGT" * 30, "I" * 120), ("ID2 x", "GATTACA", "!!!!!!!")], "id string, seq string, qual string").coalesce(1)
    for kind in ("fasta", "fastq", "embl", "genbank"):
        files.write_sequences(rows.withColumn("id", F.split("id", " ")[0]), f"{tmp_path}/{kind}", kind)
        back = files.read_sequences(spark, f"{tmp_path}/{kind}/part-*", kind)
        assert sorted((r.id, r.seq) for r in back.collect()) == [("ID1", "ACGT" * 30), ("ID2", "GATTACA")]
    assert files.read_fasta_split(spark, f"{tmp_path}/fasta/part-*").count() == 2
    with pytest.raises(T.ParseError):
        list(T.read_fasta("! ID1\nACGT\n"))
    with pytest.raises(T.ParseError):
        list(T.read_fasta(">ID1\nACGPT\n"))
    refs = [("ref", 34)]
    text = "read1\t41\tref\t1\t61\t1S1M1D1M1I\tref\t10\t300\tACGT\t!##$\tAS:i:2\tNM:i:7\nread2\t42\tref\t2\t62\t1H7M1D1M1S2H\tref\t10\t300\tAGGCTGNAG\t!##$&'()*\txy:B:S,3,4,5\n"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:ref\tLN:34\n" + text)
    sam = files.read_sam(spark, f"{tmp_path}/a.sam")
    first = sam.where("id = 'read1'").first()
    assert (first.ref_offset, first.mate.pos, first.seq, first.tags["NM"].value) == (0, 9, "ACGT", "7")
    assert files.sam_header(spark, f"{tmp_path}/a.sam")["SQ"][0]["SN"] == "ref"
    data = files.bam_files(sam.coalesce(1), refs).first().content
    (tmp_path / "a.bam").write_bytes(data)
    again = files.read_bam(spark, f"{tmp_path}/a.bam")
    assert sorted(r.value for r in files.sam_lines(again).collect()) == sorted(r.value for r in files.sam_lines(sam).collect())
    assert list(T.read_vienna("> a\nACGU\n(..) (-3.71)\n")) == [("a", "ACGU", "(..)", -3.71)]
