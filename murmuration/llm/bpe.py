"""Byte-level BPE with word ends: encoding with an index of pair occurrences, and decoding."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, strings

WORDS_AT_ONCE = 20_000
PASSES = 24  # over all words of a batch, one merge of each
NEVER = (1 << 31) - 1  # rank of pairs that do not merge
_SPACE = regex.compile(r"\p{White_Space}+")
_NO_WHITE_SPACE = "\x1c\x1d\x1e\x1f"  # where str.split splits all the same


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    ids: dict[str, int]
    tokens: list[str]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair: rank, merged token
    suffix: str
    special: dict[str, int]
    pattern: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizer file with lower-casing normalisation, a split pattern and a BPE model."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for token, k in [*ids.items(), *special.items()]:
            tokens[k] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(ids, tokens, merges, suffix, special, split["pattern"]["Regex"])


class PairIndex:
    """All words of a batch side by side; every active pair is listed with the place where it occurs, ranks in ascending order.

    A pass merges the first pair of every word, the lowest rank at its leftmost place, strikes the pairs it destroys and
    lists those it creates; words without an active pair leave.  After ``PASSES`` only long words are left: their pairs are
    taken from a heap, the lowest rank first, and merged wherever they still stand.
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        # A pair is one number, its place in the list of merges another: both are cheaper to look up than tuples.
        self.shift = max((max(pair) for pair in merges), default=0).bit_length()
        self.ranks = {left << self.shift | right: rank for (left, right), (rank, _) in merges.items()}
        self.parts = {rank: (*pair, merged) for pair, (rank, merged) in merges.items()}
        self.most = 1 << self.shift
        pairs = sorted(self.ranks)
        self.pairs = np.array([*pairs, np.iinfo(np.int64).max], np.int64)  # the last one stands for pairs that never merge
        self.pair_ranks = np.array([*(self.ranks[p] for p in pairs), NEVER], np.int64)
        self.merged = np.zeros(max(self.parts, default=-1) + 1, np.int64)
        for rank, (_, _, merged) in self.parts.items():
            self.merged[rank] = merged

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << self.shift | right
        keys[(left >= self.most) | (right >= self.most)] = -1  # in no pair
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NEVER)

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, sizes = self.encode_flat(np.fromiter(chain.from_iterable(words), np.int64, sizes.sum()), sizes)
        ends = np.cumsum(sizes).tolist()
        flat = symbols.tolist()
        return [flat[start:end] for start, end in zip([0, *ends], ends)]

    def encode_flat(self, symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols one after the other and the number of each word; the same of what they become."""
        found_sizes = np.zeros(len(sizes), np.int64)
        word = np.flatnonzero(sizes)
        size = sizes[word]
        start = np.cumsum(size) - size
        rank = np.full(len(symbol), NEVER)
        rank[:-1] = self._ranks_of(symbol[:-1], symbol[1:])
        rank[start + size - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []  # words and their symbols

        def leave(which: np.ndarray, symbols: np.ndarray) -> None:
            found_sizes[word[which]] = size[which]
            done.append((word[which], symbols))

        for _ in range(PASSES):
            if not len(word):
                break
            listed = rank << 32 | np.arange(len(rank))
            first = np.minimum.reduceat(listed, start)
            ready = first >> 32 == NEVER
            if ready.any():
                gone = np.repeat(ready, size)
                leave(ready, symbol[gone])
                left = (start - (np.cumsum(size * ready) - size * ready))[~ready]
                first = first[~ready] - start[~ready] + left
                symbol, rank = symbol[~gone], rank[~gone]
                word, size, start = word[~ready], size[~ready], left
                if not len(word):
                    break
            at = first & 0xFFFFFFFF
            symbol[at] = self.merged[first >> 32]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, rank = symbol[stays], rank[stays]
            before = np.arange(len(word))  # as many places went before those of a word
            at, start, size = at - before, start - before, size - 1
            rank[at] = NEVER
            here = at[at + 1 < start + size]
            rank[here] = self._ranks_of(symbol[here], symbol[here + 1])
            here = at[at > start]
            rank[here - 1] = self._ranks_of(symbol[here - 1], symbol[here])
        if len(word):
            flat, ends = symbol.tolist(), (start + size).tolist()
            rest = self._walk([flat[s:e] for s, e in zip(start.tolist(), ends)])
            size = np.fromiter(map(len, rest), np.int64, len(rest))
            leave(np.ones(len(word), bool), np.fromiter(chain.from_iterable(rest), np.int64, size.sum()))
        out = np.empty(found_sizes.sum(), np.int64)
        begin = np.cumsum(found_sizes) - found_sizes
        for words, symbols in done:
            n = found_sizes[words]
            out[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, found_sizes

    def _walk(self, words: list[list[int]]) -> list[list[int]]:
        symbol = list(chain.from_iterable(words))
        ends = list(accumulate(map(len, words)))
        total = len(symbol)
        after = list(range(1, total + 1))
        before = list(range(-1, total - 1))
        start = 0
        for end in ends:
            if end > start:
                before[start] = after[end - 1] = -1
            start = end
        places: dict[int, list[int]] = {}
        rank_of, parts, shift, most = self.ranks.get, self.parts, self.shift, self.most
        first = np.array(symbol, np.int64)
        keys = np.full(total, -1)
        keys[:-1] = first[:-1] << shift | first[1:]
        keys[:-1][(first[:-1] >= most) | (first[1:] >= most)] = -1  # in no pair
        keys[np.array([e - 1 for e in ends if e], np.int64)] = -1
        for at, rank in enumerate(map(rank_of, keys.tolist())):
            if rank is not None:
                if rank in places:
                    places[rank].append(at)
                else:
                    places[rank] = [at]
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            todo = places.pop(rank, None)
            if not todo:
                continue
            todo.sort()
            left, right, merged = parts[rank]
            pairs = merged < most
            for k, at in enumerate(todo):
                nxt = after[at]
                if symbol[at] != left or nxt < 0 or symbol[nxt] != right:
                    continue
                symbol[at], symbol[nxt] = merged, -1
                after[at] = far = after[nxt]
                after[nxt] = -1
                lower = False
                if far >= 0:
                    before[far] = at
                    if pairs and (other := symbol[far]) < most and (found := rank_of(merged << shift | other)) is not None:
                        if found in places:
                            places[found].append(at)
                        else:
                            places[found] = [at]
                            heapq.heappush(heap, found)
                        lower = found < rank
                if (prev := before[at]) >= 0:
                    if pairs and (other := symbol[prev]) < most and (found := rank_of(other << shift | merged)) is not None:
                        if found in places:
                            places[found].append(prev)
                        else:
                            places[found] = [prev]
                            heapq.heappush(heap, found)
                        lower |= found < rank
                if lower:  # a pair that goes first has come up: the rest of this list waits
                    if rest := todo[k + 1 :]:
                        if rank in places:
                            places[rank].extend(rest)
                        else:
                            places[rank] = rest
                        heapq.heappush(heap, rank)
                    break
        out, start = [], 0
        for end in ends:
            out.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.index = PairIndex(vocabulary.merges)
        self.words = regex.compile(vocabulary.pattern)
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        shown, ids = byte_characters(), vocabulary.ids
        self.inner = np.array([ids.get(shown[b], -1) for b in range(256)], np.int64)
        self.last = np.array([ids.get(shown[b] + vocabulary.suffix, -1) for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}  # the ids of a word, four bytes each

    def normalised(self, text: str) -> str:
        """NFC, white space runs to one space, lower case character by character (sigma has no final form)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if any(c in text for c in _NO_WHITE_SPACE):
            text = _SPACE.sub(" ", text)
        else:  # the same in one step; white space at the ends is in no word
            text = " ".join(text.split())
        return text.replace("Σ", "σ").lower()

    def split(self, text: str | None) -> list[str]:
        """Words of the text; special tokens stand for themselves."""
        if not text:
            return []
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(self.normalised(text))
        out = []
        for part in self.specials.split(text):
            out += [part] if part in self.vocabulary.special else self.words.findall(self.normalised(part))
        return out

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the bytes of all words, one after the other, and the number of each word; bytes without a symbol go."""
        data = [word.encode() for word in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        octets = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[octets]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[octets[ends]]
        unknown = symbols < 0
        if unknown.any():
            sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[unknown], minlength=len(sizes))
            symbols = symbols[~unknown]
        return symbols, sizes

    def learn(self, texts: Iterable[list[str]]) -> None:
        """Encode the words that have not been seen yet, many at once."""
        new = [w for w in set(chain.from_iterable(texts)) if w not in self.known]
        special = self.vocabulary.special
        for w in special.keys() & set(new):
            self.known[w] = np.int32(special[w]).tobytes()
        new = [w for w in new if w not in special]
        for start in range(0, len(new), WORDS_AT_ONCE):
            part = new[start : start + WORDS_AT_ONCE]
            symbols, sizes = self.index.encode_flat(*self.letters(part))
            data, ends = symbols.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
            self.known.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends))

    def encode(self, texts: list[list[str]]) -> list[list[int]]:
        self.learn(texts)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32).tolist() for words in texts]

    def forget(self, most: int) -> None:
        """Keep the memory of a long partition bounded."""
        if len(self.known) > most:
            self.known.clear()

    def decode(self, ids: list[int]) -> str:
        """Tokens with one space between them; special ones are shown."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def bpe_encode(docs: DataFrame, path: str, text: str = "text", rows_at_once: int = 200,
               words_known: int = 250_000) -> DataFrame:
    """Every row with ``token_ids`` (array<int>) and ``decoded``, the text that the ids give back.

    ``path`` is a tokenizer file that every executor has.  Special tokens inside a text become their ids, nothing
    is added at the ends.  Null and empty texts give no ids and an empty text.  Rows are encoded on their own, so
    order, ties and repeated rows have no influence; input columns named like results are replaced.
    """
    def worker(batches: Batches) -> Batches:
        encoder = Encoder(Vocabulary.load(path))
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                ids = encoder.encode([encoder.split(t) for t in strings(batch, text)])
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
                yield appended(
                    batch,
                    token_ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    decoded=pa.array([encoder.decode(i) for i in ids], pa.string()),
                )
                encoder.forget(words_known)

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return append_columns(docs, fields, worker)
