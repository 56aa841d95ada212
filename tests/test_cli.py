"""Every command on small files, and arguments that are refused."""

import pytest

from seqframe import cli


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "refs.fa").write_text("> one\nACGTACGTAACCGGTT\n> two\nTTTTTTTT\n")
    (tmp_path / "reads.fa").write_text("> r\nAACCGG\n> s\nAACCTG\n")
    return tmp_path


def test_commands(spark, folder):
    at = lambda name: str(folder / name)
    cli.main(["convert", at("refs.fa"), at("out"), "--to", "embl", "--min-length", "9", "--reverse-complement"], spark)
    from seqframe.sources import files

    assert [tuple(r) for r in files.read_sequences(spark, at("out") + "/part-*", "embl", fields=("id", "seq")).collect()] == [("one", "AACCGGTTACGTACGT")]
    cli.main(["kmers", at("refs.fa"), at("kmers"), "-k", "2"], spark)
    assert {r.hash: r.n for r in spark.read.parquet(at("kmers")).collect()}[15] == 8
    cli.main(["search", at("reads.fa"), at("refs.fa"), at("hits"), "-k", "3"], spark)
    assert [(r.name, r.reference_id, r.reference_begin_position) for r in spark.read.parquet(at("hits")).collect()] == [("r", "one", 8)]
    cli.main(["map", at("reads.fa"), at("refs.fa"), at("mapped"), "-e", "1", "-k", "3"], spark)
    mapped = {(r.name, r.reference_id, r.ref_offset) for r in spark.read.parquet(at("mapped")).collect()}
    assert ("r", "one", 8) in mapped and ("s", "one", 8) in mapped


@pytest.mark.parametrize("args", [["convert", "x.unknown", "y", "--to", "fasta"], ["convert", "x.sam", "y", "--to", "fasta"], ["kmers", "x.fa", "y", "-k", "99"], [], ["search", "x.fa"]])
def test_refused(args):
    with pytest.raises(SystemExit):
        cli.main(args)
