"""Language identification: script ranges, per-word scores, and Viterbi spans of mixed texts.

Learning counts, over a bounded share of the labelled documents of each language, letters by script
and the hashed character n-grams of words. A word's score for a language is the mean logarithm of
its n-grams' probabilities; languages never seen in the script of its letters are out.

A text's path of languages maximises the sum of scores less a penalty for each switch. If no
stretch favours another language by more than the penalties of leaving and returning (a running
maximum shows that), the path is the best single language; other texts get the full recursion.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.util import WordRows, distinct_words, gram_buckets, map_batches, utf8

BUCKETS = 1 << 14
STORE = 200_000
#: Words whose n-grams are hashed at once.
BLOCK = 16_384
#: First and last code point of letter ranges, by script; other letters are one more script.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]


def script_of(letter: str) -> int:
    c = ord(letter)
    return NAMES.index(next((s for s, a, b in SCRIPTS if a <= c <= b), "other"))


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def all_latin(letters: str) -> bool:
    """Whether all letters lie in the first range of the Latin script."""
    return letters.isascii() or max(letters) <= "\u024f"


def grams(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word's letters between word marks, and how many each word has."""
    return gram_buckets(letters, (2, 3, 4), BUCKETS)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: language x bucket; scripts: language x script, letters seen."""
        self.languages = languages
        self.log = np.log((counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * BUCKETS))
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = share > 0.001
        self.counts, self.scripts = counts, scripts
        self.known = WordRows(self.words, block=BLOCK)

    def __reduce__(self) -> tuple:
        return Model, (self.languages, self.counts, self.scripts)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word for the languages, then its letters; without letters all zero."""
        letters = [letters_of(w.decode("utf-8", "replace")) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1))
        some = [i for i, x in enumerate(letters) if x]
        if not some:
            return out
        flat, sizes = grams([letters[i] for i in some])
        count = np.array([len(letters[i]) for i in some])
        score = np.add.reduceat(self.log.T[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0).T / sizes * np.minimum(4.0, 1 + count / 3)
        script = np.array([0 if all_latin(letters[i]) else Counter(map(script_of, letters[i])).most_common(1)[0][0] for i in some])
        allowed = self.allowed[:, script]
        allowed |= ~allowed.any(axis=0)
        score = np.where(allowed, score, score.min(axis=0) - 10)
        out[some, :-1] = (score - score.max(axis=0)).T
        out[some, -1] = count
        return out

    def path(self, scores: np.ndarray, penalty: float) -> np.ndarray:
        """Index of a language for each word; ties go to the language already taken, then to the first.

        No path beats the best single language if no stretch of another gains more than the penalty,
        and a beginning and an end in others together gain no more than one penalty: of s switches,
        s - 1 are then paid for by the stretches between those two at best.
        """
        best = int(scores.sum(axis=0).argmax())
        gain = np.cumsum(np.vstack([np.zeros(scores.shape[1]), scores - scores[:, [best]]]), axis=0)
        within = (gain - np.minimum.accumulate(gain, axis=0)).max()
        if within <= penalty and gain.max() + (gain[-1] - gain).max() <= penalty:
            return np.full(len(scores), best)
        return self.viterbi(scores, penalty)

    @staticmethod
    def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
        n, k = scores.shape
        value, back = scores[0].tolist(), np.zeros((n, k), np.int16)
        each = range(k)
        for i, row in enumerate(scores[1:].tolist(), 1):
            top = max(each, key=value.__getitem__)
            other = value[top] - penalty
            for j in each:
                if value[j] >= other:
                    back[i, j] = j
                    value[j] += row[j]
                else:
                    back[i, j] = top
                    value[j] = other + row[j]
        at = max(each, key=value.__getitem__)
        out = np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            out[i] = at
            at = back[i, at]
        return out

    def spans(self, found: np.ndarray, penalty: float = 8.0) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language, its share of the letters, spans (language, first word, end)) of words' rows; und without letters."""
        letters = found[:, -1]
        total = letters.sum()
        if not total:
            return "und", 0.0, []
        path = self.path(found[:, :-1], penalty)
        share = np.bincount(path, letters, len(self.languages))
        cuts = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)]
        top = int(share.argmax())
        return self.languages[top], float(share[top] / total), [(self.languages[path[a]], int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def identify(self, texts: pa.Array, penalty: float = 8.0) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """spans() of every text of a block."""
        starts, number, words = distinct_words(texts)
        if not self.languages or not len(words):
            return [("und", 0.0, [])] * len(texts)
        rows = self.known.rows(words, np.bincount(number, minlength=len(words)))
        return [self.spans(rows[number[a:b]], penalty) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def fit(docs: DataFrame, max_docs: int = 2000) -> Model:
    """Model of the rows of docs (doc_id, text, lang) with a language: of each language all rows, or about max_docs by hashed doc_id.

    Counting runs in the tasks; the driver gets languages x buckets numbers.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, int(1e6 * min(1.0, max_docs / sizes[k])) + 1)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, found in words.items():
                t = total.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                letters = [(x, n) for x, n in ((letters_of(w.decode("utf-8", "replace")), n) for w, n in found.items()) if x]
                for i in range(0, len(letters), BLOCK):
                    block = letters[i : i + BLOCK]
                    flat, sizes = grams([x for x, _ in block])
                    t[:BUCKETS] += np.bincount(flat, np.repeat([float(n) for _, n in block], sizes), BUCKETS).astype(np.int64)
                    for x, n in block:
                        for s, m in ({0: len(x)} if all_latin(x) else Counter(map(script_of, x))).items():
                            t[BUCKETS + s] += n * m
            words.clear()

        for b in batches:
            for t, lang in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(t.split())
            if sum(map(len, words.values())) > STORE:
                flush()
        flush()
        for lang, t in total.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(t[some])], ["lang", "place", "n"])

    counted = map_batches(sample.select("text", "lang"), run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BUCKETS + len(NAMES)))
    table[[languages.index(x) for x in counted["lang"]], counted["place"].to_numpy(np.int64)] = counted["n"]
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


@functools.lru_cache(2)
def _loaded(data: bytes) -> Model:
    return pickle.loads(data)


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., lang_pred, score, spans of every row by its whole text; score is the language's share of the letters.

    Null texts, texts without a letter, and all texts when nothing was learnt are und with score 0.
    Rows are independent: repeated rows repeat, further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # languages x buckets numbers
    columns = list(dict.fromkeys((*keep, "text")))  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(shared.value)
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = own.identify(b.column(columns.index("text")), penalty)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([[{"lang": x, "start": s, "end": e} for x, s, e in r[2]] for r in rows], span)],
                [*keep, "lang_pred", "score", "spans"],
            )

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*columns), run, f"{fields}lang_pred string, score double, spans array<struct<lang: string, start: long, end: long>>")
