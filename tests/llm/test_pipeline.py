import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from seqframe.llm import simhash, stages
from seqframe.llm.util import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a plain version of its rule on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    lang = materialise(corpus_pipeline.language_id(spark, docs, SF), "t")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert lang.columns == columns and all(before[r.doc_id] == r.text for r in lang.collect()) and lang.count() > 0.9 * docs.count()
    one = materialise(corpus_pipeline.simhash_dedup(spark, lang, SF), "t")
    fp = {r.doc_id: np.uint64(simhash.fingerprint((r.text or "").encode(), 5)) for r in lang.collect()}
    kept, group = set(), {}
    for i in sorted(fp):
        stack = [i] if i not in group else []
        kept |= set(stack)
        while stack:
            j = stack.pop()
            group[j] = i
            stack += [k for k in fp if k not in group and int(fp[k] ^ fp[j]).bit_count() <= 4]
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept
    less = materialise(corpus_pipeline.substring_dedup(spark, one, SF), "t")
    seen, want = set(), {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else r.text
        if text or not any(gone):
            want[r.doc_id] = text
    assert less.columns == columns and {r.doc_id: r.text for r in less.collect()} == want
    mixed = materialise(corpus_pipeline.mixing(spark, less, SF), "t")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(want)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encoding(spark, mixed, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(lib.encode(want[r.doc_id] or "")).encode()).hexdigest()


@pytest.mark.parametrize("block", [4096, 7])
def test_near_dedup(spark, monkeypatch, block):
    """The pipeline's near-dedup against exact Jaccard similarity of all pairs and the links of 4 bits."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert corpus_pipeline.near_dedup in [f for _, f in corpus_pipeline.STAGES]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for at in rng.choice(300, 4, replace=False):
                v[at] = "other"
            rows.append(" ".join(v))
    base = [f"v{x}" for x in range(120)]  # a cluster whose members mostly reach each other through others only
    for _ in range(80):
        v = list(base)
        for at in rng.choice(120, rng.integers(1, 5), replace=False):
            v[at] = f"z{rng.integers(0, 9)}"
        rows.append(" ".join(v))
    rows += [rows[3], "few words", "few words", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [set(simhash.shingles((t or "").encode(), 5)) for t in rows]
    fp = [simhash.fingerprint((t or "").encode(), 5) for t in rows]
    like = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept, seen = set(), set()
    for i in range(len(rows)):
        stack = [] if i in seen else [i]
        kept |= set(stack)
        seen |= set(stack)
        while stack:
            j = stack.pop()
            new = [k for k in range(len(rows)) if k not in seen and like(j, k)]
            seen |= set(new)
            stack += new
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == kept
    assert len(kept) < corpus_pipeline.simhash_dedup(spark, docs, SF).count()


def test_stages_lose_nothing(spark):
    """Null and repeated identifiers, repeated rows, null and empty texts, and columns of clashing names, through every stage."""
    filler = [" ".join(f"{c}word{i}" for i in range(30)) for c in "abcdefgh"]
    rows = [(1, filler[0]), (1, filler[1]), (None, filler[2]), (None, filler[3]), (2, filler[4]), (2, filler[4]), (3, None), (4, ""), (5, filler[5] + " " + filler[0]), (6, filler[6])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, often int, kept string, row int, key int, id int, d int, t int, p int"
    more = (1, "x", 1, 1, 1, 1, 1, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t in rows], schema).repartition(3)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    lang = corpus_pipeline.language_id(spark, docs, SF)
    assert lang.columns == columns and pairs(lang) == sorted([r for r in rows if r[1]], key=str)
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == columns and pairs(near) == sorted({r for r in rows if r != (4, "")}, key=str)
    less = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert less.columns == columns and pairs(less) == sorted([(i, filler[5] if i == 5 else t) for i, t in rows], key=str)
    even = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    assert pairs(stages.mixed(docs, even)) == sorted(rows, key=str)  # one domain: all rates are 1
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0


def test_run(spark, tmp_path):
    """run() as a whole: the stages' rules one after the other, by brute force but for the models' own decisions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    lang = {r.doc_id: r for r in stages.keep_language(docs).collect()}
    text = {i: r.text for i, r in lang.items()}
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in text.items()}
    fp = {i: simhash.fingerprint(t.encode(), 5) for i, t in text.items()}
    like = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    seen, kept = set(), []
    for i in sorted(text):
        if i in seen:
            continue
        kept.append(i)
        stack = [i]
        seen.add(i)
        while stack:
            j = stack.pop()
            new = [k for k in text if k not in seen and like(j, k)]
            seen |= set(new)
            stack += new
    windows, less = set(), []
    for i in kept:
        w = text[i].encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in windows:
                gone[k : k + 20] = [True] * 20
            windows.add(key)
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else text[i]
        if left:
            less.append((i, left, lang[i].lang, lang[i].source, len(left)))
    mixture = stages.mixed(spark.createDataFrame(less, docs.schema), labels).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in mixture:
        ids = lib.encode(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 50
