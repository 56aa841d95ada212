"""Substring dedup with suffix automata of reference shards.

A window is a run of words; windows whose words also start earlier (smaller identifier, then
earlier start) cover words to remove. Equal windows hold the same minimiser: their smallest hash of
GRAM consecutive words. So only windows whose minimiser occurs more than once in the corpus can
repeat, and such places, the anchors, are about a seventh of all words, few of them repeated.

1. Anchors of all texts are counted; a repeated one belongs to its earliest place. Counts and places
   are salted, so that a very frequent anchor is spread over many tasks.
2. A stretch of SEGMENT words of a document, around the anchors that belong to places in it, is a
   reference shard. Every document's passages go to the shards of their anchors; neighbouring anchors
   of one shard share a passage. If a shard is asked for by very many passages, they are dealt to
   several tasks and the shard goes to each of these (a stretch of bounded size, whatever the texts).
3. A task builds the shard's suffix automaton and streams the passages through it in order. At each
   word the matching statistic, cut to a window, leads to the state whose earliest end decides. In a
   shard of one task, passages with windows not seen before join the automaton. In a dealt shard
   such windows can repeat between its tasks, so their words are sent on, and an aggregation by these
   words finds the earliest place of each.

Texts are shuffled once, those with repeated anchors twice. What is removed is decided by words, here
and there; hashes only bring together what may be equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.automaton import SuffixAutomaton
from seqframe.llm.util import map_batches, materialise, release, utf8, with_totals

WINDOW, GRAM = 20, 8
#: Passages, and bytes of passages, of a shard for one task; a shard with more is dealt to several.
DEAL, DEAL_BYTES = 256, 1 << 19
#: Words of a document's stretch that makes one shard.
SEGMENT = 4096
#: Spans that a task holds before it sends them on.
SPANS = 16384
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return (h ^ (h >> np.uint64(29))) * _ODD


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text), over one buffer without a loop over words."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    size = stops - starts
    h = np.zeros(len(starts), np.uint64)
    left, at = np.arange(len(starts)), 0
    while len(left):  # eight bytes of every word at a time
        chunk = np.zeros(len(left), np.uint64)
        for k in range(8):
            inside = size[left] > at + k
            chunk |= np.where(inside, buffer[np.minimum(starts[left] + at + k, len(buffer) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        h[left] = _mix(h[left] * _STEP + chunk)
        at += 8
        left = left[size[left] > at]
    h = _mix(h + size.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    return h, counts


def anchors(h: np.ndarray, counts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of every place whose gram hash is smallest of some window of one text; ties all count."""
    w = window - gram + 1
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.r_[0, np.cumsum(counts)]
    n = len(h) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g * _ODD + h[j : n + j]
    g = np.maximum(_mix(g), np.uint64(1))
    m = len(h) - window + 1
    least = g[:m].copy()
    for j in range(1, w):
        np.minimum(least, g[j : m + j], out=least)
    least[text[:m] != text[window - 1 :]] = 0  # windows over the end of a text don't count
    most = np.zeros(n, np.uint64)
    for j in range(w):
        np.maximum(most[j : m + j], least, out=most[j : m + j])
    at = np.flatnonzero(most == g)
    return text[at], at - starts[text[at]], g[at]


def _summary(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _merged(places: np.ndarray, window: int, gram: int, n: int) -> list[tuple[int, int]]:
    """Passages (first word, end) that hold all windows around the places, which ascend."""
    lo, hi = np.maximum(0, places - (window - gram)), np.minimum(n, places + window)
    cut = np.flatnonzero(lo[1:] >= hi[:-1] - window + 2)  # no window lies in both
    return list(zip(lo[np.r_[0, cut + 1]].tolist(), hi[np.r_[cut, len(hi) - 1]].tolist(), strict=True)) if len(places) else []


def _walk(automaton: SuffixAutomaton, words: list[bytes], place: tuple[int, int], start: int, window: int) -> tuple[list[list[int]], list[int]]:
    """(spans covered by windows that start earlier elsewhere, starts of windows the automaton lacks) of a passage."""
    step, link, length, first = automaton.step, automaton.link, automaton.length, automaton.first
    follow = automaton.follow
    state = matched = 0
    covered: list[list[int]] = []
    fresh: list[int] = []
    for i, word in enumerate(words, 1):
        nxt = step[state].get(word)
        if nxt is None:
            state, matched = follow(state, matched, word)
        else:
            state, matched = nxt, matched + 1
        if matched >= window:
            while length[link[state]] >= window:
                state = link[state]
            matched = window
            if first[state] < (*place, start + i):
                if covered and i - window <= covered[-1][1]:
                    covered[-1][1] = i
                else:
                    covered.append([i - window, i])
        elif i >= window:
            fresh.append(i - window)
    return covered, fresh


def _stream(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (d, t and stretch of the shard, deal, deals, reference, d, t, start, passage) in order of shard, deal, reference first, place."""
    shard = automaton = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["d", "t", "first", "end", "words"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            *at, deals, reference, d, t, start, passage = row
            if at != shard:
                shard, automaton, seen = at, SuffixAutomaton(), {}
            words = passage.split(b" ")
            if reference:
                automaton.add(words, [(d, t, start + i + 1) for i in range(len(words))])
                continue
            if deals == 1 and (known := seen.get(passage)) is not None and known < (d, t, start):
                out.append((d, t, start, start + len(words), None))  # all its windows were seen
                continue
            covered, fresh = _walk(automaton, words, (d, t), start, window)
            if deals == 1:
                if fresh:  # what repeats within the passage shows once it has joined
                    automaton.add(words, [(d, t, start + i + 1) for i in range(len(words))])
                    covered, _ = _walk(automaton, words, (d, t), start, window)
                seen.setdefault(passage, (d, t, start))
            else:
                out.extend((d, t, start + a, start + a + window, b" ".join(words[a : a + window])) for a in fresh)
            out.extend((d, t, start + a, start + z, None) for a, z in covered)
            if len(out) >= SPANS:
                yield batch()
        yield batch()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_row: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row of docs; with_row: row (all its columns), n_removed, and kept, the words left
    joined by a space, which is null where none was removed.

    Null and empty texts have no words, texts of any length are taken whole. Rows of the same
    identifier and text are one document, and get the same result; rows of one identifier and
    different texts are ordered by a hash of the text. A null identifier counts as smaller than any
    other. Texts shorter than a window lose nothing. An empty table gives an empty result; further
    columns have no influence, whatever their names.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if with_row else []))
    keyed = keyed.select("id", F.coalesce("id", F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t"), "text", *(["row"] if with_row else []))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, word, g = anchors(*word_hashes(utf8(b.column(2))), window, gram)
            d, t = (b.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(d), pa.array(t), pa.array(word.astype(np.int32))], ["g", "d", "t", "word"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [x.split() for x in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(w) for w in split], pa.int64()), pa.array([_summary(w) for w in split])], ["id", "d", "t", "n_words", "sha"])

    found = map_batches(keyed.select("d", "t", "text"), find, "g long, d long, t long, word int")
    counts, repeated = with_totals(found, ["g"], ["d", "word"], F.count(F.lit(1)).alias("n"), "n > 1")
    again = materialise(counts.drop("n"), "anchors")
    owned, owners = with_totals(again, ["g"], ["d", "word"], F.min(F.struct("d", "t", "word")).alias("o"))
    stretch = F.floor(F.col("o.word") / SEGMENT).cast("int")
    places = owned.groupBy("d", "t").agg(F.collect_set(F.struct(F.col("o.d").alias("s_d"), F.col("o.t").alias("s_t"), stretch.alias("s_w"), "word")).alias("places"))
    # documents with repeated anchors, their texts and places
    touched = materialise(keyed.select("d", "t", "text").dropDuplicates(["d", "t"]).join(places, ["d", "t"]), "touched")
    release(repeated, again, owners)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3), strict=True):
                words = text.split()
                s_d, s_t, s_w, word = (x.to_numpy(zero_copy_only=False) for x in at.values.flatten())
                order = np.lexsort((word, s_w, s_t, s_d))
                s_d, s_t, s_w, word = s_d[order], s_t[order], s_w[order], word[order]
                edge = np.flatnonzero((s_d[1:] != s_d[:-1]) | (s_t[1:] != s_t[:-1]) | (s_w[1:] != s_w[:-1])) + 1
                for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(word)].tolist(), strict=True):
                    out += [(int(s_d[lo]), int(s_t[lo]), int(s_w[lo]), d, t, a, b" ".join(words[a:z])) for a, z in _merged(word[lo:hi], window, gram, len(words))]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["s_d", "s_t", "s_w", "d", "t", "start", "passage"])

    passages = materialise(map_batches(touched, cut, "s_d long, s_t long, s_w int, d long, t long, start int, passage binary"), "passages")
    share = F.greatest(F.count(F.lit(1)) / DEAL, F.sum(F.length("passage")) / DEAL_BYTES)
    shard = ["s_d", "s_t", "s_w"]
    asked, sizes = with_totals(passages, shard, ["d", "t", "start"], F.ceil(share).cast("int").alias("deals"))
    streamed = asked.withColumn("deal", F.pmod(F.xxhash64("d", "t", "start"), F.col("deals")).cast("int")).withColumn("reference", F.lit(False))
    within = F.col("start").between(F.col("s_w") * SEGMENT - window, (F.col("s_w") + 1) * SEGMENT)
    shards = asked.where((F.col("deals") > 1) & (F.col("s_d") == F.col("d")) & (F.col("s_t") == F.col("t")) & within)
    shards = shards.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).withColumn("reference", F.lit(True))
    columns = [*shard, "deal", "deals", "reference", "d", "t", "start", "passage"]
    rows = streamed.select(columns).union(shards.select(columns)).repartition(*shard, "deal")
    rows = rows.sortWithinPartitions(*shard, "deal", F.col("reference").desc(), "d", "t", "start")
    spans = materialise(map_batches(rows, lambda batches: _stream(batches, window), "d long, t long, first long, end long, words binary"), "spans")
    release(passages, sizes)
    timed, _ = with_totals(spans.where("words IS NOT NULL"), ["words"], ["d", "first"], F.min(F.struct("d", "t", "first")).alias("at"))
    later = timed.where(F.struct("d", "t", "first") > F.col("at")).select("d", "t", "first", "end")
    removed = spans.where("words IS NULL").select("d", "t", "first", "end").union(later).groupBy("d", "t").agg(F.collect_list(F.struct("first", "end")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3), strict=True):
                words = text.split()
                first, end = (x.to_numpy(zero_copy_only=False) for x in at.values.flatten())
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, first, 1)
                np.add.at(gone, end, -1)
                gone = np.cumsum(gone)[:-1] > 0
                left = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                rows.append((d, t, int(gone.sum()), _summary(left), b" ".join(left) if with_row else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "t", "n_removed", "left_sha", "kept"])

    changed = map_batches(touched.select("d", "t", "text").join(removed, ["d", "t"]), keep, "d long, t long, n_removed long, left_sha string, kept binary")
    gone = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    if with_row:
        return keyed.select("d", "t", "row").join(changed, ["d", "t"], "left").select("row", gone, F.col("kept").cast("string").alias("kept"))
    every = map_batches(keyed, summarise, "id long, d long, t long, n_words long, sha string")
    return every.join(changed.drop("kept"), ["d", "t"], "left").select(F.col("id").alias(id_col), "n_words", gone, F.coalesce("left_sha", "sha").alias("kept_sha256"))
