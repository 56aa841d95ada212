"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No vocabulary piece spans a word mark that follows another letter or a newline that isn't its first
letter (a model with such pieces is refused), so a text falls into words that merge independently.
The distinct unseen words of a block are laid out as flat arrays of symbols. A round finds, per word,
the least rank of a pair, merges its places in all words at once, and compacts the arrays; words
without a pair leave. Where the pairs of a merged piece all rank after it, a round merges all places
of the least rank, of overlapping ones every other from the left: nothing a merge makes can come
before them. Of other pieces it merges the places up to the first whose merge makes a pair of that
rank or a lesser one. The ranks of pairs are kept and recomputed only beside a merge. A word of any
length is merged that way.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.util import map_batches

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words kept with their ids; beyond that the store is emptied before a block.
STORE = 300_000


class PieceCodec:
    """Encoder and decoder of one model of type BPE with byte fallback and the identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece[1:] for p in proto.pieces if p.type == 1):
            raise ValueError("models with pieces over the bounds of words are not supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        kinds = {p.piece: (i, p) for i, p in enumerate(proto.pieces)}
        self.ids = {s: i for s, (i, p) in kinds.items() if p.type == 1}
        self.bytes = np.array([kinds[f"<0x{b:02X}>"][0] for b in range(256)], dtype=np.int32)
        surface: list[bytes] = [b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        for b in range(256):
            surface[int(self.bytes[b])] = bytes([b])
        surface[next(i for i, p in enumerate(proto.pieces) if p.type == 2)] = " ⁇ ".encode()
        self.surface = pa.array(surface, pa.binary())
        self.decimal = pa.array([str(i).encode() for i in range(len(surface))], pa.binary())
        scores = sorted({-p.score for p in proto.pieces if p.type == 1})
        rank = {s: r for r, s in enumerate(scores)}
        pairs = sorted((self.ids[s[:k]] << 32 | self.ids[s[k:]], rank[-proto.pieces[i].score], i) for s, i in self.ids.items() for k in range(1, len(s)) if s[:k] in self.ids and s[k:] in self.ids)
        self._table([p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs])
        # ranks whose merged pieces take part in pairs of later rank only
        next_rank = np.full(len(surface), NONE)
        for key, r, _ in pairs:
            for part in (key >> 32, key & 0xFFFFFFFF):
                next_rank[part] = min(next_rank[part], r)
        self.all_at_once = np.ones(len(scores) + 1, bool)
        for _, r, merged in pairs:
            self.all_at_once[r] &= bool(next_rank[merged] > r)
        self._forget()

    def _forget(self) -> None:
        self.store: dict[str, int] = {}  # words met several times in a block: their row in the two arrays
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _table(self, keys: list[int], ranks: list[int], merged: list[int]) -> None:
        """Open-addressing table from pairs of ids to their rank and merged id."""
        self.bits = max(4, (8 * max(1, len(keys))).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        k, r, m = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(merged, np.int32)
        slot, self.probes = self._slot(k), 0
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = first[free[first]]
            self.keys[at[take]], self.ranks[at[take]], self.merged[at[take]] = k[todo[take]], r[todo[take]], m[todo[take]]
            todo = np.delete(todo, take)
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        h = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where no piece joins it; ids below 0 join nothing."""
        out = np.full(len(left), -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) << 32 | right[todo]
        slot = self._slot(key)
        while len(todo):
            seen = self.keys[slot]
            hit = seen == key
            out[todo[hit]] = slot[hit]
            go = ~hit & (seen >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, how many each has) of words with their marks, by rounds over all words at once."""
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(letters):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        chars, inverse = np.unique(letters, return_inverse=True)
        found = np.array([self.ids.get(chr(c), -1 - int(c)) for c in chars], dtype=np.int64)  # below 0: spelled in bytes
        sym = found[inverse]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []

        def pair(i: np.ndarray) -> np.ndarray:
            j = np.minimum(i + 1, len(sym) - 1)
            return self.lookup(np.where((j > i) & (word[i] == word[j]), sym[i], -1), sym[j])

        slot = pair(np.arange(len(sym)))
        while len(sym):
            rank = np.where(slot >= 0, self.ranks[slot], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():  # compaction: finished words leave
                gone = np.repeat(~live, sizes)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                sym, word, slot, rank = sym[~gone], word[~gone], slot[~gone], rank[~gone]
                if not len(sym):
                    break
                sizes, least = sizes[live], least[live]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # every other place of a run of overlapping ones
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            some = ~self.all_at_once[rank[at]]
            if some.any():
                some[some] = self._later(sym, word, rank, slot, at[some])
                at = at[~some]
            sym[at] = self.merged[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the compaction: one symbol less for each merge before
            sym, word, slot = sym[keep], word[keep], slot[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            slot[touched] = pair(touched)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._spell(sym[order], word[order], len(words))

    def _later(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which places follow one in their word whose merge makes a pair that comes before them."""
        made = self.merged[slot[at]].astype(np.int64)
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        before = np.where((at > 0) & (word[left] == word[at]), sym[left], -1)
        before[1:] = np.where(at[1:] - at[:-1] == 2, made[:-1], before[1:])
        after = np.where((at + 2 < len(sym)) & (word[right] == word[at]), sym[right], -1)
        early = np.zeros(len(at), bool)
        for slots in (self.lookup(before, made), self.lookup(made, after)):
            early |= (slots >= 0) & (self.ranks[slots] <= rank[at])
        count = np.cumsum(early) - early
        first = np.flatnonzero(np.r_[True, word[at[1:]] != word[at[:-1]]])
        return count > np.repeat(count[first], np.diff(np.r_[first, len(at)]))

    def _spell(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters that no piece has become the ids of their bytes."""
        odd = np.flatnonzero(sym < 0)
        size = np.ones(len(sym), np.int64)
        letters, which = np.unique(sym[odd], return_inverse=True)
        spelled = [self.bytes[np.frombuffer(chr(-1 - int(x)).encode("utf-8", "surrogatepass"), np.uint8)] for x in letters]
        size[odd] = np.array([len(x) for x in spelled], np.int64)[which] if len(odd) else 1
        at = np.cumsum(size) - size
        out = np.repeat(sym, size).astype(np.int32)
        for k, ids in enumerate(spelled):
            out[at[odd[which == k]][:, None] + np.arange(len(ids))] = ids
        return out, np.bincount(word, size, n).astype(np.int64)

    def units(self, text: str) -> list[str]:
        """Keys of a text's words: 'w' stands for a marked word, a leading newline for an unmarked one, a leading NUL for one with its marks."""
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return ["\0" + x for x in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)] if text else []

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(first word of each text and the end, number of every word among the distinct ones, those)."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}|\\x00") if self.prefix else pa.array([True] * len(texts))
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        others = [self.units(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd], sizes[odd] = np.diff(plain.offsets.to_numpy()), [len(u) for u in others]
        every = pa.concat_arrays([plain.flatten(), pa.array(list(itertools.chain(*others)), pa.string())]).dictionary_encode()
        number = every.indices.to_numpy()
        if odd.any():  # back into the order of the texts
            start = np.zeros(len(texts), np.int64)
            start[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
            start[odd] = sizes[~odd].sum() + np.cumsum(sizes[odd]) - sizes[odd]
            number = number[np.arange(len(number)) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)]
        return np.r_[0, np.cumsum(sizes)], number, every.dictionary.to_pylist()

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """(first word of each text and the end, number of every word among the distinct ones, ids of those)."""
        starts, number, units = self._cut(texts)
        if len(self.store) > STORE:
            self._forget()
        row = np.fromiter(map(self.store.get, units, itertools.repeat(-1)), np.int64, len(units))
        unseen = np.flatnonzero(row < 0)
        new = [units[i] for i in unseen.tolist()]
        merged = [self.merge([u[1:] if u[:1] == "\0" else u if u[:1] == "\n" else MARK + u for u in new[at : at + 65536]]) for at in range(0, len(new), 65536)]
        ids, counts = (np.concatenate([e, *(m[k] for m in merged)]) for k, e in enumerate((np.zeros(0, np.int32), np.zeros(0, np.int64))))
        flat, ends, old = np.concatenate([self.flat, ids]), np.r_[self.ends, self.ends[-1] + np.cumsum(counts)], len(self.ends) - 1
        row[unseen] = old + np.arange(len(unseen))
        size = (ends[1:] - ends[:-1])[row]
        stop = np.cumsum(size)
        table = flat[np.arange(size.sum()) + np.repeat(ends[row] - stop + size, size)]
        often = np.bincount(number, minlength=len(units))[unseen] > 1
        self.store.update(zip(itertools.compress(new, often.tolist()), range(old, old + int(often.sum())), strict=True))
        self.flat, self.ends = np.concatenate([self.flat, ids[np.repeat(often, counts)]]), np.r_[self.ends, self.ends[-1] + np.cumsum(counts[often])]
        return starts, number, pa.ListArray.from_arrays(pa.array(np.r_[0, stop].astype(np.int32)), pa.array(table))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text, without begin or end ids; null counts as empty."""
        starts, number, words = self.words(pa.array(texts, pa.string()))
        return [words.take(pa.array(number[a:b])).flatten().to_numpy() for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def _text(self, raw: bytes, first: int) -> bytes:
        """UTF-8 of the surfaces of ids, of which the first is given, without the one mark put in front."""
        if self.prefix and raw[:1] == b" " and first != self.bytes[32]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes joined, marks as spaces."""
        return self._text(b"".join(self.surface.take(pa.array(ids)).to_pylist()), ids[0] if len(ids) else -1).decode()

    def joined(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, those in decimals joined by commas, decoded text in UTF-8) of each text of a block."""
        starts, number, words = self.words(texts)
        flat, offsets, cuts = words.flatten(), words.offsets, pa.array(starts.astype(np.int32))
        sizes, first = np.diff(offsets.to_numpy()), flat.take(offsets[:-1]).to_numpy()

        def of(parts: pa.Array, glue: bytes) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(cuts, pc.binary_join(pa.ListArray.from_arrays(offsets, parts.take(flat)), glue).take(pa.array(number))), glue)

        n = np.diff(np.r_[0, np.cumsum(sizes[number])][starts])
        for i, (k, ids, raw) in enumerate(zip(n.tolist(), of(self.decimal, b","), of(self.surface, b""), strict=True)):
            yield k, ids.as_py(), self._text(raw.as_py(), first[number[starts[i]]] if k else -1)


@functools.lru_cache(1)
def _codec(path: str) -> PieceCodec:
    """One codec for each worker process, with the words it has met."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., ids array<int>, decoded string: every whole text encoded and decoded again.

    Null and empty texts have no ids and decode to an empty text. Texts and words of any length are
    encoded whole. Rows are independent, so repeated rows repeat and further columns are ignored; an
    empty table gives an empty result. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            texts = b.column(len(keep))
            starts, number, words = codec.words(texts)
            sizes = np.diff(words.offsets.to_numpy())[number]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)][starts].astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, words.take(pa.array(number)).flatten())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], ids, pa.array([x.decode() for _, _, x in codec.joined(texts)], pa.string())], [*keep, "ids", "decoded"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, F.col(text_col)), run, f"{fields}ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, as encode_documents() has them; ids and texts stay in the worker.

    Null and empty texts have no ids; null identifiers stay; repeated rows repeat; further columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = _codec(model), hashlib.sha256
        for b in batches:
            rows = [(n, sha(ids).hexdigest(), sha(text).hexdigest()) for n, ids, text in codec.joined(b.column(1))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
