"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds licence templates and the base phrases. Every text is streamed: words outside
the automaton's vocabulary reset the match, the others follow it, which gives at each word the
length of the longest match that ends there (the matching statistic). A base phrase ends where the
match's suffix chain holds it. Long matches are chained per template where their places in text and
template both advance; the chain's words over the template's are its coverage.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.automaton import SuffixAutomaton
from seqframe.llm.util import map_batches, utf8

# Phrases of the base, and opening or operative passages of public licence texts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "released under the mit license",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-notice": "licensed under the apache license version 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}

#: Lower-cases A-Z and turns every ASCII character but digits and letters into a space.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class LicenceScanner:
    """min_match: least words of a match to be chained; gap: most words between matches of a chain;
    coverage: least share of a template that its chain must cover for the label."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = 4, gap: int = 12, coverage: float = 0.5) -> None:
        self.templates, self.phrases = templates or TEMPLATES, phrases or PHRASES
        self.min_match, self.gap, self.coverage = min_match, gap, coverage
        self.names = sorted(self.templates)
        self.sizes = [len(self.templates[n].split()) for n in self.names]
        sequences = [self.templates[n].encode().split() for n in self.names] + [p.encode().split() for p in self.phrases]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.sequences = [[self.ids[w] for w in s] for s in sequences]
        self.automaton = a = SuffixAutomaton()
        for s in self.sequences:
            a.add(s, range(1, len(s) + 1))
        # templates and ends at which each state's longest match occurs
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for t, s in enumerate(self.sequences[: len(self.names)]):
            state = matched = 0
            for i, w in enumerate(s):
                state, matched = a.follow(state, matched, w)
                at = state
                while at > 0:
                    ends[at].add((t, i + 1))
                    at = a.link[at]
        self.ends = {k: sorted(v) for k, v in ends.items()}
        # phrases that end wherever a state is reached by a long enough match
        own: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for (_, label), s in zip(self.phrases.items(), self.sequences[len(self.names) :], strict=True):
            state = matched = 0
            for w in s:
                state, matched = a.follow(state, matched, w)
            own[state].append((len(s), label))
        self.closed: list[list[tuple[int, str]]] = [[] for _ in a.link]
        for state in sorted(range(len(a.link)), key=a.length.__getitem__):
            self.closed[state] = own.get(state, []) + (self.closed[a.link[state]] if state else [])
        self.least = min([min_match, *(len(s) for s in self.sequences[len(self.names) :])])

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(words, base places as (start, label), spans as (template, start, end, coverage)) of a whole text."""
        words = words_of(text)
        found = np.fromiter(map(self.ids.get, words, [0] * len(words)), np.int32, len(words))
        known = found > 0
        edges = np.flatnonzero(np.diff(np.r_[False, known, False]))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.least  # shorter runs hold neither a phrase nor a match to chain
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # start and end in the text, state
        a, follow, closed = self.automaton, self.automaton.follow, self.closed
        for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            state = matched = 0
            for i, w in enumerate(found[s:e].tolist(), s):
                before = (state, matched)
                state, matched = follow(state, matched, w)
                if matched <= before[1] and before[1] >= self.min_match:
                    matches.append((i - before[1], i, before[0]))  # a maximal match ended
                if closed[state]:
                    base.extend((i + 1 - n, label) for n, label in closed[state] if n <= matched)
            if matched >= self.min_match:
                matches.append((e - matched, e, state))
        return len(words), base, self.chain(matches) if matches else []

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of templates: matches whose places in text and template both advance, with small gaps.

        The matches are maximal, so their starts and ends ascend together, and those that end within
        gap words of a start are the only ones that can come before it in a chain.
        """
        of: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for s, e, state in matches:
            for t, end in self.ends.get(state, ()):
                of[t].append((s, e, end - (e - s), end))
        spans = []
        for t, items in of.items():
            items.sort()
            best: list[tuple[int, int]] = []  # covered words and start of the best chain that ends with each match
            for k, (s, e, u, v) in enumerate(items):
                top = (e - s, s)
                for j in range(k - 1, -1, -1):
                    s2, e2, u2, v2 = items[j]
                    if e2 < s - self.gap:  # ends ascend: no earlier match is near enough
                        break
                    if s2 < s and u2 < u and -self.gap <= s - e2 <= self.gap and u - v2 <= self.gap:
                        over = max(0, e2 - s, v2 - u)
                        if over < e - s:
                            top = max(top, (best[j][0] + e - s - over, best[j][1]))
                best.append(top)
            for (covered, start), (_, e, _, _) in zip(best, items, strict=True):
                share = min(1.0, covered / self.sizes[t])
                if share >= self.coverage:
                    spans.append((self.names[t], start, e, share))
        kept: dict[str, list[tuple[int, int, float]]] = defaultdict(list)  # of each template, in order, none over another
        for t, s, e, share in sorted(spans, key=lambda x: (-x[3], x[1], x[2], x[0])):  # the best cover of overlapping spans of a template
            own = kept[t]
            at = bisect.bisect_left(own, (s,))
            if (not at or own[at - 1][1] <= s) and (at == len(own) or own[at][0] >= e):
                own.insert(at, (s, e, share))
        return sorted(((t, *x) for t, own in kept.items() for x in own), key=lambda x: (x[1], x[2], x[0]))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """id, n_words, places array<start, label>, spans array<template, start, end, coverage> of every whole text.

    Null and empty texts have no words and nothing found; texts are streamed whole, whatever their
    length. An empty table gives an empty result. Rows are independent; repeated rows repeat,
    further columns are ignored. Nothing is shuffled; the automaton depends on the templates alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(**options)
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        for b in batches:
            rows = [scanner.scan(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[{"start": s, "label": x} for s, x in p] for _, p, _ in rows], place),
                    pa.array([[{"template": x, "start": s, "end": e, "coverage": c} for x, s, e, c in q] for _, _, q in rows], span),
                ],
                ["id", "n_words", "places", "spans"],
            )

    schema = "id long, n_words long, places array<struct<start: long, label: string>>, spans array<struct<template: string, start: long, end: long, coverage: double>>"
    found = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)
    return found.withColumnRenamed("id", id_col)


def licence_labels(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from scan_licences()."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    more = F.transform("spans", lambda s: F.substring_index(s["template"], "-", 1))
    starts = F.col("places.start")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
