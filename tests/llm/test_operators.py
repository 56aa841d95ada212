import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqframe.llm import ann, iblt, language, licenses, mixing, pieces, quality, simhash, sstable, substring
from seqframe.llm.util import with_totals

A = " ".join(f"w{i}" for i in range(60))
B = " ".join(f"v{i}" for i in range(60))
TEXTS = {
    1: A, 2: A + " end", 3: B + " " + A[:120], 4: None, 5: "", 6: " \n\t ", 7: "x", 8: A, 9: "la la " * 40, 10: "Released under the MIT License.\nApache license; GENERAL public LICENSE " * 3,
    11: "don't  stop <|endoftext|>   中文 ▁ é\n\n end ", 12: B, 13: " ".join(f"u{i}" for i in range(3000)) + " " + A,
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, fp long, p string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t or ""), 1, 1, "x") for k, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[0], (None, "lost one", None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def of(t):
    return t or ""


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2

    def fp(t):
        w = of(t).encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    fps = {k: fp(t) for k, t in TEXTS.items()}
    comp = {k: k for k in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id} == {(k, f"{fps[k]:016x}", comp[k]) for k in fps}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_cells():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x ^ np.uint64(1 << 5), x ^ np.uint64(0b1111 << 30), x ^ np.uint64(1 | 1 << 21 | 1 << 43 | 1 << 63)]))
    for z in (1, 2, 3):
        found = set()
        for cell in simhash.cells(x, 4, z):
            for c in np.unique(cell):
                for a, b in simhash.forest(x[cell == c], 4):
                    found |= set(zip(a.tolist(), b.tolist(), strict=True))
        check_links(x, found)


def check_links(x, found):
    parent = {int(v): int(v) for v in x}

    def root(v, p=parent):
        while p[v] != v:
            v = p[v]
        return v

    for a, b in found:
        assert (a ^ b).bit_count() <= 4
        parent[root(a)] = root(b)
    for a in x.tolist():
        for b in x.tolist():
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


def test_simhash_split_cells(spark):
    """Cells of many more members than a block gives the same links."""
    rng = np.random.default_rng(2)
    x = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    table = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for limit in (5, 1000):
        check_links(x, {(r.a % 2**64, r.b % 2**64) for r in simhash.links(table, 4, limit).collect()})


def test_pieces(docs, empty):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_documents(docs, path).where("doc_id IS NOT NULL").collect():
        ids = lib.encode(of(TEXTS[r.doc_id]))
        assert r.ids == ids and r.decoded == lib.decode(ids)
    for r in pieces.encoding_digests(docs, path).where("doc_id IS NOT NULL").collect():
        ids = lib.encode(of(TEXTS[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert pieces.encoding_digests(empty, path).count() == 0
    codec = pieces.PieceCodec(path)
    rng = np.random.default_rng(3)
    odd = ["aaaa" * 500, "▁▁a  b", "\x00é", " " * 40, "the" * 300, "中文😀" * 50, "", "\n\n", " a", "a "]
    odd += ["".join(rng.choice(list("acgt"), 10_000)), "".join(rng.choice(list("abcdefghij"), 10_000)), "ab" * 5000]
    name = {i: s for s, i in codec.ids.items()}
    early = [name[int(m)].strip("▁") for k, r, m in zip(codec.keys, codec.ranks, codec.merged, strict=True) if k >= 0 and not codec.all_at_once[r]]
    odd += [x * 400 for x in early[::200] if x] + ["".join(rng.choice(early, 300)) for _ in range(5)]
    assert [x.tolist() for x in codec.encode(odd)] == lib.encode(odd)
    assert [codec.decode(x) for x in codec.encode(odd)] == [lib.decode(x) for x in lib.encode(odd)]


def test_pieces_other_models(tmp_path):
    """Models whose pieces cross the bounds of words are refused."""
    from sentencepiece import sentencepiece_model_pb2

    for piece, kind in (("a▁b", 1), ("a\n", 1), ("<user>", 4)):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
        proto.pieces.add(piece=piece, type=kind, score=-1e6)
        (tmp_path / "m").write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError, match="not supported"):
            pieces.PieceCodec(str(tmp_path / "m"))


def test_sstable(spark, docs, empty, tmp_path):
    path, out = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/shards"
    got = sorted(sstable.token_shards(docs.where("doc_id IS NOT NULL").distinct(), path, out).collect(), key=lambda r: r.doc_id)
    lib, start = Tokenizer.from_file(path), 0
    for r, (k, t) in zip(got, sorted(TEXTS.items()), strict=True):
        ids = [*lib.encode(of(t), add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = {r.doc_id: r.ids for r in sstable.lookup(spark, out, [1, 7, 99, -5]).collect()}
    assert set(found) == {1, 7} and found[7] == [*lib.encode("x").ids, 0]
    assert sstable.token_shards(empty, path).count() == 0
    assert sstable.token_shards(docs, path).count() == len(TEXTS) + 2


def test_sstable_small_shards(spark, tmp_path):
    """Shards cut by parts and by bytes; more rows of one identifier, and of none, than a range has."""
    path = P.path("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    rows = [(None if i < 200 else 7 if i < 400 else i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    lib = Tokenizer.from_file(path)
    size = [len(x.ids) + 1 for x in lib.encode_batch([t for _, t in rows], add_special_tokens=False)]
    for n, (parts, most) in enumerate(((6, 1 << 30), (1024, 40_000))):
        out = f"file://{tmp_path}/s{n}"
        sstable.write_shards(d, path, out, shard_parts=parts, shard_bytes=most)
        files = sstable.shard_files(spark, out).collect()
        assert len(files) > 20 and max(len(r.content) for r in files) < 1_000_000
        assert sum(sstable.Shard(bytes(r.content)).tokens for r in files) == sum(size)
        got = sorted(((*sstable._place(r.shard), r.local_start, r) for r in sstable.read_shards(spark, out).collect()), key=lambda x: x[:3])
        ids = [x[3].doc_id for x in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and sorted(x[3].n_tokens for x in got) == sorted(size)
        assert {r.doc_id for r in sstable.lookup(spark, out, [7, 450, 5000]).collect()} == {7, 450}


def test_quality_and_mixing(spark, docs, empty):
    rows = [(i, ("good word here now " if i % 2 else "bad!! junk!! ###") * (3 + i % 5), None, "s", 1, 1, 1, "x") for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(200)] + [(None, 1, 0), (250, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(d, labels).collect()
    assert len(got) == 300 and all((r.predicted == r.doc_id % 2) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0
    mixed, report = mixing.mix(d, labels, {"q1t0": 0.8, "q0t0": 0.2})
    assert mixed.count() == 300 and report["q1t0"]["expected"] == pytest.approx(report["q1t0"]["target"], rel=0.05)
    assert mixing.mix(empty, labels)[0].count() == 0
    assert {r.rate for r in mixing.mix(docs, none)[0].collect()} == {1.0}


def test_quality_forward_and_held_out(spark, docs):
    """Scores against a plain forward pass, and accuracy on rows that were not learnt."""
    from seqframe.llm import subword

    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_quality(table, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = sum(got[i].predicted == q for i, q in truth.items() if i in got) / len(truth)
    most = max(sum(truth.values()), len(truth) - sum(truth.values())) / len(truth)
    assert len(truth) > 300 and right > 0.93 > most, (right, most)
    usable = labels.where("quality IN (0, 1)").where(~quality.held_out(5, 0)).selectExpr("doc_id", "CAST(quality AS STRING) AS label")
    model = subword.fit(table, usable)
    plain = lambda w: [zlib.crc32(w, 7) % len(model.effect), *subword.gram_buckets([w.decode()], (3, 4), len(model.effect))[0]]
    for r in table.limit(40).collect():
        rows = [b for w in (r.text or "").encode().split() for b in plain(w)]
        z = model.bias + (np.mean(model.effect[rows].astype(float), axis=0) if rows else 0)
        assert got[r.doc_id].score == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-6)
    odd = {r.doc_id: r.score for r in quality.score_quality(table.select("doc_id", "text").union(docs.select(-F.col("doc_id"), "text")), labels).collect()}
    assert odd[-4] == odd[-5] == odd[-6] and 0 <= odd[-4] <= 1  # null, empty and white space: the bias


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(table.where(~quality.held_out(4, 2)))
    rows = language.identify(table.where(quality.held_out(4, 2)), model, keep=("doc_id", "lang")).where("lang IS NOT NULL").collect()
    assert len(rows) > 2000 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.995


def test_mixing_against_dense_solver(spark):
    """Rates against accelerated projected gradient steps on all documents at once, with and without a floor."""
    rng = np.random.default_rng(8)
    n = rng.integers(1, 50, 400).astype(float)
    p = rng.dirichlet([0.4, 0.6, 0.8], 400)
    table = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n, strict=True)], "p array<double>, n_words long").repartition(3)
    natural = n @ p
    target = np.array([0.2, 0.3, 0.5]) * natural.sum()
    for kept, least, most in ((-1, 0.0, np.inf), (0, 0.6, np.inf), (0, 0.3, 2.2)):
        floor = mixing._floor(p, kept, least)
        dual, expected = mixing._solve(table, natural, target, kept, least, 100, 1e-9, most)
        assert expected == pytest.approx(target, rel=1e-6)
        rates = mixing._rates(p, dual, floor, most)
        size, x = n.sum(), np.zeros(3)
        y, t = x, 1.0
        for _ in range(20_000):  # the dual of least n (r - 1)^2 under the targets
            r = np.clip(1 + p @ y, floor, most)
            new = y - ((n * r) @ p - target) / size
            t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            y, x = new + (old - 1) / t * (new - x), new
        assert rates == pytest.approx(np.clip(1 + p @ x, floor, most), abs=1e-4)


def test_mixing_meets_every_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    mixed, report = mixing.mix(docs, labels, keep="q1t0")
    rows, names = mixed.collect(), sorted(report)
    total = sum(r.rate * r.n_words * np.array(r.p) for r in rows)
    assert min(r.rate for r in rows) >= 0 and sum(r.rate == 0 for r in rows) > 0
    for i, x in enumerate(names):
        assert total[i] == pytest.approx(report[x]["target"], rel=1e-4) and report[x]["met"], x
    few = spark.createDataFrame([(i, "good word here now", i % 2, 0) for i in range(40)], "doc_id long, text string, quality int, toxic int")
    with pytest.warns(UserWarning, match="did not reach"):  # equal texts cannot be told apart
        _, report = mixing.mix(few, few.select("doc_id", "quality", "toxic"), {"q0t0": 0.9, "q1t0": 0.1})
    assert not all(x["met"] for x in report.values())


def test_licences(docs, empty):
    for r in licenses.licence_labels(licenses.scan_licences(docs)).where("doc_id IS NOT NULL").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), of(TEXTS[r.doc_id])))
        places = [(i, x) for p, x in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licences(empty).count() == 0
    scanner = licenses.LicenceScanner()
    words = licenses.TEMPLATES["mit"].split()
    _, _, spans = scanner.scan((A + " " + " ".join([*words[:40], "changed", *words[41:]]) + " " + B).encode())
    assert [(t, s) for t, s, _, c in spans if t == "mit" and c > 0.9] == [("mit", 60)]


def test_licence_chains():
    """The chain of each match is the best of all chains, by brute force; many licences in one text."""
    scanner = licenses.LicenceScanner()
    words = {k: v.split() for k, v in licenses.TEMPLATES.items()}
    rng = np.random.default_rng(6)

    def brute(matches):
        items = sorted((t, s, e, end - (e - s), end) for s, e, state in matches for t, end in scanner.ends.get(state, ()))
        best = {}
        for t, s, e, u, v in items:
            top = (e - s, s)
            for (t2, s2, e2, u2, v2), (c, start) in best.items():
                over = max(0, e2 - s, v2 - u)
                if t2 == t and s2 < s and u2 < u and abs(s - e2) <= scanner.gap and u - v2 <= scanner.gap and over < e - s:
                    top = max(top, (c + e - s - over, start))
            best[t, s, e, u, v] = top
        return max(((min(1.0, c / scanner.sizes[t]), scanner.names[t]) for (t, *_), (c, _) in best.items()), default=(0, ""))

    for _ in range(60):
        text = []
        for name in rng.choice(sorted(words), 3):
            w = list(words[name])
            for _ in range(rng.integers(0, 30)):
                at = int(rng.integers(0, len(w)))
                w[at : at + 1] = [["odd"], [], [w[at], w[at]], w[: int(rng.integers(0, 9))]][int(rng.integers(0, 4))]
                w = w or ["odd"]
            text += w
        seen = []
        chain = scanner.chain
        scanner.chain = lambda m, seen=seen, chain=chain: seen.append(m) or chain(m)
        _, _, spans = scanner.scan(" ".join(text).encode())
        scanner.chain = chain
        share, _ = brute(seen[0]) if seen else (0, "")
        assert max((c for *_, c in spans), default=0) == pytest.approx(share if share >= scanner.coverage else 0)
    gpl = " ".join([w for x in (words["gpl"],) for w in x] * 200)
    assert len([s for s in scanner.scan(gpl.encode())[2] if s[0] == "gpl"]) == 200
    halved = " ".join(x for _ in range(200) for x in [*words["gpl"][:30], "odd", *words["gpl"][31:]])
    assert len([s for s in scanner.scan(halved.encode())[2] if s[0] == "gpl" and s[3] > 0.9]) == 200


def test_language(spark, docs, empty):
    en, fr = "the cat and the dog with this ", "le chat et les chiens avec cette "
    rows = [(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr", "s", 1, 1, 1, "x") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    test = spark.createDataFrame([(1, en * 20 + fr * 10), (2, None), (3, "12 !!"), (4, fr), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(test, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "und", "und", "fr", "und"]
    assert [s.lang for s in got[1].spans] == ["en", "fr"] and got[1].spans[0].end == 140
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    rng = np.random.default_rng(0)
    for _ in range(100):
        s = rng.normal(size=(rng.integers(1, 25), 3)) * 3
        value = lambda p, s=s: s[np.arange(len(p)), p].sum() - 4 * (np.diff(p) != 0).sum()
        assert value(model.path(s, 4.0)) == pytest.approx(value(language.Model.viterbi(s, 4.0)))


@pytest.mark.parametrize("deal", [256, 1])
def test_substring(docs, empty, monkeypatch, deal):
    monkeypatch.setattr(substring, "DEAL", deal)
    got = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    seen = set()
    for k, t in sorted(TEXTS.items()):
        w = of(t).encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), sum(gone), hashlib.sha256(left).hexdigest()), k
    assert substring.dedup_substrings(empty).count() == 0


def test_substring_many_passages(spark, monkeypatch):
    """A shard asked for by very many passages, copies of one row, and stretches of a long document."""
    monkeypatch.setattr(substring, "DEAL", 16)
    monkeypatch.setattr(substring, "SEGMENT", 64)
    rng = np.random.default_rng(7)
    line = " ".join(f"c{i}" for i in range(9))
    other = [" ".join(f"x{j}" for j in rng.integers(0, 40, 15)) for _ in range(12)]
    rows = [(i, f"{other[rng.integers(0, 12)]} {line} {other[rng.integers(0, 12)]}") for i in range(300)]
    rows += [(1000, " ".join(f"{line} {o}" for o in other * 3)), (2000, rows[0][1])]
    d = spark.createDataFrame([*rows, *[(None, rows[5][1])] * 400], "doc_id long, text string").repartition(5)
    got: dict = {}
    for r in substring.dedup_substrings(d).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    seen: set = set()
    for k, t in [(None, rows[5][1]), *rows]:
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()
        assert set(got[k]) == {(len(w), sum(gone), hashlib.sha256(left).hexdigest())}, k
    assert len(got[None]) == 400


def test_blocks(spark):
    """The size of blocks holds whatever else is built, and leaves the session alone."""
    from seqframe.llm.util import map_batches

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small = map_batches(spark.range(5000), run, "n long", 100)
    map_batches(spark.range(10), run, "n long", 4000)
    assert max(r.n for r in small.collect()) == 100 and sum(r.n for r in small.collect()) == 5000
    wide = map_batches(spark.range(200).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1), run, "n long", size=100_000)
    assert max(r.n for r in wide.collect()) <= 12
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_totals_of_frequent_keys(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id % 700) AS k", "id")
    got, _ = with_totals(rows, ["k"], ["id"], F.count(F.lit(1)).alias("n"), "n > 7")
    count = {}
    for r in rows.collect():
        count[r.k] = count.get(r.k, 0) + 1
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted((r.k, r.id, count[r.k]) for r in rows.collect() if count[r.k] > 7)


def test_iblt(spark, docs, empty):
    d = docs.where("doc_id IS NOT NULL").distinct()
    order = sorted(TEXTS, reverse=True)
    sets = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in iblt.fingerprints(d).collect():
        t, n = of(TEXTS[r.doc_id]), of(TEXTS[order[(order.index(r.doc_id) + 1) % len(order)]])
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(sets(t), sets(e))) and r.near_next == pytest.approx(like(sets(t), sets(n)))
    assert iblt.fingerprints(docs).count() == len(TEXTS) + 2
    assert iblt.fingerprints(empty).count() == 0
    assert iblt.fingerprints(docs.where("doc_id = 12")).first().near_next == 1.0
    # a part with far too many digests for the first table
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64(i)).alias("a"))
    small, large = (F.array_size(iblt.peel(iblt.subtract(iblt.table(F.col("a"), m), iblt.table(F.array().cast("array<long>"), m)), m)) for m in (F.lit(16), F.lit(256)))
    assert tuple(wide.select(small, large).first()) == (None, 200)


def test_iblt_by_fingerprints_alone(spark):
    """Texts of 1 to 500 lines: likenesses from the two columns alone, digests from one, folding, order of lines."""
    rng = np.random.default_rng(5)
    rows = [(i, "\n".join(f"line {x}" for x in rng.integers(0, 3 * n, n))) for i, n in enumerate([*range(1, 60), 99, 100, 130, 200, 201, 350, 500])]
    rows += [(100, "a\nb\nc"), (101, "c\nb\na"), (102, "a\nb\nc"), (103, "a\na\nb\nc")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = iblt.fingerprints(d)
    both = got.select("doc_id", "near_edited", "near_next", "fingerprint", iblt.likeness(iblt.parse(F.col("fingerprint")), iblt.parse(F.col("edited_fingerprint"))).alias("again"))
    lines = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text, order = dict(rows), sorted(dict(rows), reverse=True)
    fps = {}
    for r in both.collect():
        t, n = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.again == r.near_edited == pytest.approx(like(lines(t), lines(e))) and r.near_next == pytest.approx(like(lines(t), lines(n)))
        fps[r.doc_id] = r.fingerprint
    assert fps[100] == fps[102] and len({fps[100], fps[101], fps[103]}) == 3
    # every fingerprint gives its digests; some needed larger tables
    sizes = set()
    for cells in {int(f.split(":")[1]) for f in fps.values()}:
        some = [(i, f) for i, f in fps.items() if int(f.split(":")[1]) == cells]
        table = spark.createDataFrame(some, "doc_id long, f string").select("doc_id", iblt.decode(iblt.parse(F.col("f"))["parts"], F.lit(cells)).alias("found"))
        want = {r.doc_id: set(r.p) for r in d.select("doc_id", iblt.paragraphs(F.col("text")).alias("p")).collect()}
        assert all(set(r.found) == want[r.doc_id] for r in table.collect())
        sizes.add(cells)
    assert max(sizes) > iblt.CELLS


def test_iblt_order(spark):
    """Next rows in descending order, with many rows of one identifier and of none."""
    rows = [(None if i < 60 else 5 if i < 140 else i, f"text {i}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    h = {r.text: r.h for r in d.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    want = {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    found = iblt.with_next(d)
    assert {r.text: r.next_text for r in found.collect()} == want
    assert found.select("range").distinct().count() > 8 and max(r["count"] for r in found.groupBy("range").count().collect()) < 50


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16), (904, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got: dict = {}
    for r in ann.search(v, v.where("vec_id % 50 = 0"), k=10, lists=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = [int(i) for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        hit += len(set(true) & {i for i, _ in got[q].values()})
        assert all(s == pytest.approx(d[i], rel=1e-12) for i, s in got[q].values()) and sorted(got[q]) == list(range(1, 11))
    assert hit / 80 >= 0.95 and set(got) == set(range(0, 400, 50))
    assert [i for i, _ in (got[100][k] for k in range(1, 11))] == list(range(101, 111))
    assert ann.search(v.limit(0), v).count() == 0


@pytest.mark.parametrize(("sf", "each"), [("sf0.01", 1), ("sf0.1", 5)])
def test_neighbours_recall(spark, sf, each):
    """Recall of the query's own call against brute force on the whole table, with more queries."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids = np.array(sorted(i for i, v in rows.items() if v and None not in v and np.isfinite(v).all() and any(v)))
    x = np.array([rows[i] for i in ids.tolist()])
    got: dict = {}
    for r in ann.search(table, table.where(f"vec_id % {each} = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = of = 0
    for q in [i for i in ids.tolist() if i % each == 0]:
        d = ((x - np.array(rows[q])) ** 2).sum(1)
        true = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hit, of = hit + len(set(true) & set(got[q])), of + len(true)
    assert hit / of >= 0.95


def test_neighbours_bins(spark, monkeypatch):
    """Lists larger than a bin, many lists in one bin, repeated identifiers, and fewer candidates than asked for."""
    monkeypatch.setattr(ann, "CHUNK", 50)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.05 + 3, rng.normal(size=(300, 8))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(0, x[1].tolist())], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(v, v.where("vec_id % 60 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(60, 600, 60):
        d = ((x - x[q]) ** 2).sum(1)
        assert len(set(np.argsort(d)[1:11].tolist()) & set(got[q])) >= 8
    few = v.where("vec_id < 5")
    assert {r.query_id: r.n for r in ann.search(few, few.where("vec_id > 0"), k=10).groupBy("query_id").agg(F.count("rank").alias("n")).collect()} == dict.fromkeys(range(1, 5), 5)
    assert ann.bins(np.array([10, 30, 20, 120, 5, 50, 0, 1]))[0].tolist() == [0, 0, 1, 2, 5, 6, 6, 7]


def test_neighbours_many_copies(spark):
    """More copies of a query than a block has rows: ties go to the smallest ids."""
    x = np.random.default_rng(4).normal(size=(3000, 64))
    x[:2000] = x[0]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in np.random.default_rng(1).permutation(3000).tolist()], "vec_id long, embedding array<double>").repartition(5)
    got = ann.search(v, v.where("vec_id IN (0, 1500)"), k=10).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 1500)} == {0: list(range(1, 11)), 1500: list(range(10))}
    rows = x[:2000] @ np.linalg.qr(np.random.default_rng(7).normal(size=(64, 64)))[0]
    near = rows + 1e-15 * np.random.default_rng(2).normal(size=rows.shape)
    assert len(ann.adaptive_scan(rows[0], near, 0.0, 16, 2.1)) == 2000


def test_language_joint_path():
    """Two languages that each gain less than the penalty over the best single one can win together."""
    model = language.Model(["a", "b", "c"], np.zeros((3, language.BUCKETS)), np.zeros((3, len(language.NAMES))))
    s = np.array([[0.0, -99.0, -7.0], [-99.0, 0.0, -7.0]])
    assert model.path(s, 8.0).tolist() == [0, 1]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        s = rng.normal(size=(rng.integers(1, 8), 4)) * 4
        value = lambda p, s=s: s[np.arange(len(p)), p].sum() - 8 * (np.diff(p) != 0).sum()
        assert value(model.path(s, 8.0)) == pytest.approx(value(language.Model.viterbi(s, 8.0)))
