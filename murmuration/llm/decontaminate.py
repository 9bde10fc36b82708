"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, utf8, without

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8
WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_BYTES = 16 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Vocabulary(dict):
    """Numbers words from 1 in the order in which they are first asked for; 0 separates documents."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class SuffixArray:
    """Word suffixes of one shard, in the lexicographic order of their first ``depth`` words.

    Word numbers are packed, several to an integer; suffixes that tie are refined by the next integer.
    """

    def __init__(self, ids: np.ndarray, highest: int, depth: int):
        self.bits = max(1, int(highest).bit_length())
        self.per = min(depth, 62 // self.bits)
        self.depth = depth
        n = len(ids)
        padded = np.concatenate([ids, np.zeros(2 * depth + self.per, np.int64)])
        key = padded[: n + 2 * depth].copy()
        for j in range(1, self.per):
            key <<= self.bits
            key |= padded[j : n + 2 * depth + j]
        self.key = key
        self.order = np.argsort(key[:n])
        self.first = key[self.order]
        same = np.zeros(n + 1, bool)  # same[i]: suffix i has tied with i - 1 so far
        same[1:n] = self.first[1:] == self.first[:-1]
        for at in range(self.per, depth, self.per):
            tied = np.flatnonzero(same[:-1] | same[1:])
            if not len(tied):
                break
            group = np.cumsum(~same[:-1])[tied]
            nxt = key[self.order[tied] + at]
            by = np.lexsort((nxt, group))
            self.order[tied] = self.order[tied][by]
            nxt = nxt[by]
            still = np.zeros(len(tied), bool)
            still[1:] = (nxt[1:] == nxt[:-1]) & (group[1:] == group[:-1])
            same[tied] = still

    def _range(self, pattern: np.ndarray) -> tuple[int, int]:
        """Lowest key of suffixes that begin with the pattern, and the lowest one beyond."""
        packed = 0
        for word in pattern.tolist():
            packed = packed << self.bits | word
        free = self.bits * (self.per - len(pattern))
        return packed << free, (packed + 1) << free

    def search(self, patterns: list[np.ndarray]) -> Iterable[tuple[int, np.ndarray]]:
        """(pattern's number, positions where it occurs) of every pattern that occurs; at most ``depth`` words."""
        if not patterns:
            return
        ranges = np.array([self._range(p[: self.per]) for p in patterns], np.int64)
        low, high = np.searchsorted(self.first, ranges[:, 0]), np.searchsorted(self.first, ranges[:, 1])
        for k in np.flatnonzero(high > low).tolist():
            lo, hi, pattern = int(low[k]), int(high[k]), patterns[k]
            for at in range(self.per, len(pattern), self.per):
                nxt = self.key[self.order[lo:hi] + at]
                a, b = self._range(pattern[at : at + self.per])
                lo, hi = lo + int(np.searchsorted(nxt, a)), lo + int(np.searchsorted(nxt, b))
                if lo == hi:
                    break
            if lo < hi:
                yield k, self.order[lo:hi]


class Items:
    """The windows of a block of benchmark items."""

    def __init__(self, rows: list[tuple], window: int):
        self.ids = [r[0] for r in rows]
        self.windows: list[tuple[int, int, list[bytes]]] = []  # item, first word, words
        for k, (_, text) in enumerate(rows):
            words = words_of(text.encode() if text else None)
            if words:
                size = min(window, len(words))
                self.windows += [(k, i, words[i : i + size]) for i in range(len(words) - size + 1)]


def _maximal(item: np.ndarray, first: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Occurrences that follow each other word by word in item and document become one longest match."""
    by = np.lexsort((at, at - first, item))
    item, first, at, size = item[by], first[by], at[by], size[by]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - first[1:] != at[:-1] - first[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return [item[begin], first[begin], at[begin], at[last] + size[last] - at[begin]]


def _searched(items: Items, ids: np.ndarray, vocabulary: Vocabulary, window: int) -> list[np.ndarray]:
    """Longest matches in a shard: item, word in the item, word in the shard, number of words."""
    patterns, which = [], []
    for k, (_, _, words) in enumerate(items.windows):
        found = [vocabulary.get(w) for w in words]
        if None not in found:
            patterns.append(np.array(found, np.int64))
            which.append(k)
    hits = list(SuffixArray(ids, len(vocabulary), window).search(patterns)) if patterns else []
    if not hits:
        return [np.zeros(0, np.int64)] * 4
    at = np.concatenate([positions for _, positions in hits])
    counts = [len(positions) for _, positions in hits]
    chosen = [items.windows[which[k]] for k, _ in hits]
    item, first, size = (np.repeat(np.array(x, np.int64), counts) for x in
                         ([c[0] for c in chosen], [c[1] for c in chosen], [len(c[2]) for c in chosen]))
    return _maximal(item, first, at, size)


def _find(items: Items, text: str, window: int, kind: pa.DataType):
    fields = [("item_id", kind), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]

    def shard(batches: list, counts: list[int], ids: list[np.ndarray], vocabulary: Vocabulary) -> Batches:
        stream = np.concatenate([np.append(x, 0) for x in ids]) if ids else np.zeros(0, np.int64)
        starts = np.cumsum([0, *[c + 1 for c in counts]])
        item, first, at, size = _searched(items, stream, vocabulary, window)
        doc = np.searchsorted(starts, at, "right") - 1
        by_doc: dict[int, list] = {}
        for d, k, i, p, n in zip(doc.tolist(), item.tolist(), first.tolist(), (at - starts[doc]).tolist(), size.tolist()):
            by_doc.setdefault(d, []).append((items.ids[k], i, p, n))
        row = 0
        for batch in batches:
            earlier = batch.column("matches").to_pylist() if "matches" in batch.schema.names else [()] * len(batch)
            matches, n_hit = [], []
            for before in earlier:
                found = [*[tuple(m.values()) for m in before], *by_doc.get(row, ())]
                matches.append([dict(zip([f[0] for f in fields], m)) for m in found])
                covered, end = 0, 0
                for _, _, p, n in sorted(found, key=lambda m: m[2]):
                    covered += max(0, p + n - max(end, p))
                    end = max(end, p + n)
                n_hit.append(covered)
                row += 1
            plain = batch.select([c for c in batch.schema.names if c not in ("n_words", "n_hit", "matches")])
            yield appended(
                plain,
                n_words=pa.array(counts[row - len(batch) : row], pa.int64()),
                n_hit=pa.array(n_hit, pa.int64()),
                matches=pa.array(matches, pa.list_(pa.struct(fields))),
            )

    def worker(batches: Batches) -> Batches:
        held, counts, ids, vocabulary, total = [], [], [], Vocabulary(), 0
        for batch in batches:
            held.append(batch)
            for raw in utf8(batch, text):
                words = words_of(raw)
                ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                counts.append(len(words))
                total += len(words) + 1
            if total >= SHARD_WORDS:
                yield from shard(held, counts, ids, vocabulary)
                held, counts, ids, vocabulary, total = [], [], [], Vocabulary(), 0
        if held:
            yield from shard(held, counts, ids, vocabulary)

    return worker


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``matches`` and ``contaminated``.

    A task sorts the word suffixes of each shard of its documents (about half a million words; a document is never
    cut) and looks up all suffixes of the benchmark items by binary search.  ``matches`` are the longest verbatim
    matches of at least ``window`` words, or of a whole shorter item: item_id, first word in the item and in the
    document, number of words.  ``n_hit`` counts document words inside any match; a document is contaminated when
    they are a twentieth of its words or more.  Nothing is shuffled.

    The benchmark is the stated query set: it is read in blocks of about ``BLOCK_BYTES`` (by measured size) that
    pass over the documents one after the other, so that a task never holds more than one block for each pass.
    Words are ``[0-9a-z]`` and everything beyond ASCII, A-Z lower-cased.  Null and empty texts have no words and no
    matches; items without words are never found; repeated rows are answered alike; items with equal ids count as
    found under that id.  Input columns named like results are replaced.
    """
    kind = benchmark.schema[item_id].dataType
    pairs = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    match = T.ArrayType(T.StructType([
        T.StructField("item_id", kind), T.StructField("item_word", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
    ]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("matches", match)]
    arrow_kind = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    base = without(docs, ["n_words", "n_hit", "matches", "contaminated"])
    out = base
    for block in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        worker = _find(Items([tuple(r) for r in part.collect()], window), text, window, arrow_kind)
        if block == 0:
            out = append_columns(out, fields, worker)
        else:
            out = out.mapInArrow(worker, out.schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
