"""Registered queries of cursors, bit sets, schemes, further formats and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions import bitset as B
from seqframe.functions import letters as L
from seqframe.functions import sam as S
from seqframe.operator_queries import _DNA, _SAM, _VIENNA, _alignments, _folder, _shown
from seqframe.operators import alignments as A
from seqframe.operators import joins
from seqframe.operators.cursors import Cursors
from seqframe.queries import _PAIRS, _name_pairs, _one, _seqs, _t, query
from seqframe.sources import files
from seqframe.streaming import records as streams

# Cursors. Each nation's cursor goes from the root to a letter, on to the least letter beside it, and to the next greater one.


def _cursor_sql(left: bool) -> str:
    a, b = ("b", "a") if left else ("a", "b")
    whole = lambda kept, letter: f"{letter} || {kept}" if left else f"{kept} || {letter}"
    kept = "substr({0}, 2)" if left else "substr({0}, 1, CAST(length({0}) - 1 AS BIGINT))"
    own = "substr({0}, 1, 1)" if left else "right({0}, 1)"
    return f"""WITH T AS (SELECT p_name AS t, unnest(range(0, length(p_name) + 1)) AS i FROM part), D AS (SELECT CASE WHEN i > 0 THEN substr(t, i, 1) ELSE '' END AS a, substr(t, i + 1, 1) AS b, count(*) AS n FROM T GROUP BY 1, 2),
      E AS (SELECT {a} AS kept, {b} AS letter, n FROM D WHERE a <> '' AND b <> '' UNION ALL SELECT '', b, sum(n) FROM D WHERE b <> '' GROUP BY b),
      L1 AS (SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM E WHERE kept = '' AND letter = chr(97 + n_nationkey)) THEN chr(97 + n_nationkey) ELSE '' END AS label FROM nation),
      M AS (SELECT kept, min(letter) AS letter FROM E GROUP BY kept),
      L2 AS (SELECT n_nationkey, coalesce({whole("label", "letter")}, label) AS label FROM L1 LEFT JOIN M ON kept = label),
      N3 AS (SELECT n_nationkey, min(letter) AS letter FROM L2 JOIN E ON kept = {kept.format("label")} AND letter > {own.format("label")} GROUP BY n_nationkey),
      L3 AS (SELECT n_nationkey, coalesce({whole(kept.format("label"), "letter")}, label) AS label FROM L2 LEFT JOIN N3 USING (n_nationkey))
      SELECT CAST(n_nationkey AS BIGINT) AS cursor_id, label, CAST(n AS BIGINT) AS n FROM L3 JOIN E ON kept = {kept.format("label")} AND letter = {own.format("label")}"""


def _cursor(spark: SparkSession, sf_dir: str) -> Cursors:
    refs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("reference_id"), F.col("p_name").alias("text"))
    return Cursors.root(_t(spark, sf_dir, "nation"), refs, "n_nationkey").extend_right(F.chr(F.col("cursor_id") + 97))


@query(_cursor_sql(left=False))
def cursor_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cursor(spark, sf_dir).extend_right().cycle_back()
    return c.path().join(c.count(), "cursor_id").select("cursor_id", "label", "n")


@query(_cursor_sql(left=True))
def cursor_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cursor(spark, sf_dir).extend_left().cycle_front()
    return c.path().join(c.count(), "cursor_id").select("cursor_id", "label", "n")


# Columns.


@query("""WITH P AS (SELECT c_nationkey, list_sort(list_distinct(list(CAST(c_custkey % 150 AS INT)))) AS p, range(0, 150, 3) AS q FROM customer GROUP BY c_nationkey)
  SELECT c_nationkey, array_to_string(list_filter(p, lambda x: x % 3 = 0), ',') AS both, len(p) + 50 - len(list_filter(p, lambda x: x % 3 = 0)) AS n_or, 150 - len(p) AS n_not,
    len(p) + 50 - 2 * len(list_filter(p, lambda x: x % 3 = 0)) AS n_xor, array_to_string(list_transform(list_filter(p, lambda x: x < 80), lambda x: x + 70), ',') AS shifted, list_contains(p, 127) AS held, len(list_filter(p, lambda x: x <> 63)) + 1 AS n_set FROM P""")
def bit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set((F.col("c_custkey") % 150).cast("int")).alias("p"))
    w = p.select("c_nationkey", B.of_places("p", 150).alias("p"), B.of_places(F.sequence(F.lit(0), F.lit(149), F.lit(3)), 150).alias("q"))
    listed = lambda c: F.array_join(B.places(c).cast("array<string>"), ",")
    return w.select("c_nationkey", listed(B.and_("p", "q")).alias("both"), _one(B.count(B.or_("p", "q"))).alias("n_or"), _one(B.count(B.not_("p", 150))).alias("n_not"), _one(B.count(B.xor("p", "q"))).alias("n_xor"), listed(B.shift("p", 70, 150)).alias("shifted"), B.test("p", F.lit(127)).alias("held"), _one(B.count(B.set_("p", 63))).alias("n_set"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '[aeiou]+|[^aeiou]+'), '|') AS blocks FROM part")
def chunk_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    vowel = lambda c: c.isin(*"aeiou")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(L.chunk_by("p_name", lambda a, b: vowel(a) == vowel(b)), "|").alias("blocks"))


_ORDERED = "".join(chr(0x21 + i) for i in range(27)).replace("'", "''")


@query(f"SELECT p_partkey, translate(regexp_replace(upper(p_name), '[^A-Z*]', 'X', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ*', '{_ORDERED}') AS k FROM part")
def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", L.rank_key("p_name", "aa27").alias("k"))


@query(f"WITH {_DNA.removeprefix('WITH ')} ".replace("SELECT 'd' || doc_id AS id, s AS seq FROM S", "SELECT doc_id, translate(s, 'T', 'U') AS rna, regexp_extract(s, '^[^G]*') AS before, regexp_replace(s, '^[^G]*G*', '') AS rest FROM S"))
def letter_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seqs(spark, sf_dir).select("doc_id", L.convert("s", "dna4", "rna4").alias("rna"), L.take_until("s", "G").alias("before"), L.rest_after("s", "G").alias("rest"))


_GAPPED = "translate(p_name, 'aeiou', '-----')"


@query(f"SELECT p_partkey, {_GAPPED} AS again, len(regexp_extract_all({_GAPPED}, '-+')) AS n, CAST(length({_GAPPED}) - length(replace({_GAPPED}, '-', '')) AS BIGINT) AS gaps, CASE WHEN instr({_GAPPED}, '-') > 0 THEN instr({_GAPPED}, '-') - 1 END AS first FROM part")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", "aeiou", "-----").alias("g")).withColumn("r", A.gap_runs("g"))
    return t.select("p_partkey", A.with_gap_runs(A.ungapped("g"), "r").alias("again"), _one(F.size("r")).alias("n"), _one(F.aggregate("r", F.lit(0), lambda n, x: n + x["n"])).alias("gaps"), _one(F.get("r", 0)["at"]).alias("first"))


def _converted(c: str) -> str:
    return f"regexp_replace(translate(upper({c}), 'U', 'T'), '[^ABCDGHKMNRSTVWY]', 'N', 'g')"


@query(f"WITH {_PAIRS} SELECT p_partkey, CAST(-levenshtein({_converted('p_name')}, {_converted('other')}) AS BIGINT) AS score FROM P")
def nucleotide_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters are scored after conversion to dna15; the scheme goes through its text form."""
    cfg = A.AlignConfig(scheme=A.scheme_of(A.scheme_text(A.nucleotide_scheme())))
    return _name_pairs(spark, sf_dir).select("p_partkey", _one(A.align_pairwise("p_name", "other", cfg)["score"]).alias("score"))


# Rows.


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i BETWEEN 101 AND 300")
def record_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.slice_rows(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 300)


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0")
def mates_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of each order; the second names the first one's place unless the customer's number divides by three."""
    o = _t(spark, sf_dir, "orders")
    place = lambda at: F.struct(F.lit("r").alias("ref_id"), at.alias("pos"))

    def record(flag: int, at: Column, mate: Column) -> DataFrame:
        return o.select(F.col("o_orderkey").alias("id"), F.lit(flag).alias("flag"), F.lit("r").alias("ref_id"), at.alias("ref_offset"), place(mate).alias("mate"))

    c = F.col("o_custkey")
    rows = record(0x41, c, c + 50).union(record(0x81, c + 50, F.when(c % 3 == 0, c + 1).otherwise(c)))
    return joins.mates(rows, placed=True).select(F.col("first.id").alias("o_orderkey"))


# Files and streams.


@query(_DNA.replace("s AS seq", "s AS seq, translate(s, 'ACGT', 'I5+@') AS qual"))
def io_fastq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _seqs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("s").alias("seq"), F.translate("s", "ACGT", "I5+@").alias("qual")), _folder(spark)
    files.write_sequences(rows, path, "fastq")
    return files.read_fastq_split(spark, f"{path}/part-*")


@query(_SAM)
def io_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    files.write_bam(_alignments(spark, sf_dir)[0], path, [("ref", 1000)])
    return _shown(files.read_bam(spark, f"{path}/part-*"))


@query(f"WITH V AS ({_VIENNA}) SELECT id, CAST(length(seq) AS BIGINT) AS letters, CAST(length(replace(structure, '.', '')) AS BIGINT) AS paired, seq AS again FROM V")
def io_structure_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = F.col("p_size"), _folder(spark)
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.repeat(F.lit("A"), 2 * n + 2).alias("seq"), F.concat(F.repeat(F.lit("("), n), F.lit(".."), F.repeat(F.lit(")"), n)).alias("structure"), (-n / 2.0).alias("energy"))
    files.write_structures(rows, path, compression="gzip")
    found = files.read_structures(spark, f"{path}/part-*", fields=("id", "bpp", "structured_seq"))
    paired = F.size(F.filter("bpp", lambda x: F.size(x) > 0))
    return found.select("id", _one(F.size("structured_seq")).alias("letters"), _one(paired).alias("paired"), F.array_join(F.transform("structured_seq", lambda x: x["letter"]), "").alias("again"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")
def user_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format of lines key=name, made known by its functions."""
    if "keyed" not in files.OWN:
        files.register_format("keyed", ("keyed",), "key string, name string", lambda t: (tuple(x.split("=", 1)) for x in t.splitlines()), lambda rows: (f"{k}={v}" for k, v in rows))
    path = _folder(spark)
    files.write_records(_t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name")), path, "keyed")
    return files.read_records(spark, f"{path}/part-*", "keyed")


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer, o_orderstatus AS status FROM orders")
def user_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag of a type of one's own beside one without a known type."""
    S.register_tag("XC", "i")
    fields = F.array(F.concat(F.lit("XC:i:"), F.col("o_custkey").cast("string")), F.concat(F.lit("XS:Z:"), F.col("o_orderstatus")))
    t = _t(spark, sf_dir, "orders").select("o_orderkey", S.parse_tags(fields).alias("t"))
    return t.select("o_orderkey", S.tag_value("t", "XC").alias("customer"), S.tag_value("t", "XS").alias("status"))


@query(_DNA)
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as a stream, two a batch, each batch pushed to a callback that writes it."""
    rows, path = _seqs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("s").alias("seq")), _folder(spark)
    files.write_sequences(rows.repartition(5), f"{path}/in", "fasta")
    stream = streams.stream_sequences(spark, f"{path}/in/part-*", "fasta", max_files=2)
    streams.on_result(stream, lambda batch, n: batch.select("id", "seq").write.parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "seq")
