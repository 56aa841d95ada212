"""Generalised suffix automata over words."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Automaton of several word sequences; a state keeps the place at which its words first ended.

    add() in the order in which places count as earlier; first[state] is then the earliest end of
    every sequence in the state, as the object passed for the last word.
    """

    __slots__ = ("step", "link", "length", "first")

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list = [None]

    def _state(self, length: int, step: dict, link: int, first: object) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: Hashable) -> int:
        step, link, length = self.step, self.link, self.length
        clone = self._state(length[p] + 1, step[q].copy(), link[q], self.first[q])
        link[q] = clone
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: Sequence[Hashable], places: Sequence[object]) -> None:
        """Add one sequence; places[i] stands for its end after word i."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for word, place in zip(words, places, strict=True):
            q = step[last].get(word)
            if q is not None:  # these words are known already
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                continue
            new = self._state(length[last] + 1, {}, 0, place)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            if p >= 0:
                q = step[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = new

    def follow(self, state: int, matched: int, word: Hashable) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        step = self.step
        nxt = step[state].get(word)
        if nxt is not None:
            return nxt, matched + 1
        link = self.link
        while state and nxt is None:
            state = link[state]
            nxt = step[state].get(word)
        if nxt is None:
            return 0, 0
        return nxt, self.length[state] + 1
