"""Perplexity of documents under an interpolated modified Kneser-Ney model of word trigrams, by sharded count joins.

A trigram ``u, v, w`` goes to the part of its middle word: there its count, its context ``u, v``, the pair ``v, w`` and the
context ``v`` meet, so every document is scored beside the counts that it needs.  Frequent middle words are split over
several parts by ``u``; the counts of their pairs are added up by Spark and joined back, and so are those of single words.
Texts are stored once as numbers of their words.  Trigrams travel as packed blocks, one for each chunk of documents and part,
in ``ROUNDS`` rounds of some of the parts each, once to count trusted text and once to score all text, so that what is on disk
at once is a fraction of the whole.  The model is not broadcast or gathered, only the discounts, the list of frequent words and,
up to a limit, hashes of the trusted ids.  Words are 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm.rows import Batches, ROWS_AT_ONCE, stored
from murmuration.sources.scratch import Scratch

FOLDS = 4  # a document is scored with the counts of the trusted documents of the other folds
START, END = 0, 1
WORD = re.compile(r"\w+|[^\w\s]+")
ROUNDS = 8
ROUND_BYTES = 8 << 20  # of text, for each round where there are fewer
CHUNK_WORDS = 2_000_000  # of documents that a task packs together
CHUNK_KINDS = 1_000_000  # different words, after which a chunk ends
KEY_KINDS = 2_000_000  # different words, of which three numbers fit 63 bits
PART_BYTES = 128 << 20  # of text, for each part
SLICE_GRAMS = 800_000  # of a part, worked on at once where that is possible
SUBS = 16  # of a part: its slices are some of them
TRUSTED_IDS = 16_000_000  # hashes that tasks have (8 bytes each); beyond it the ids are joined
SAMPLE_BYTES = 16 << 20  # of text, in which frequent words are looked for: how they are dealt changes no result
ROWS_OF_BLOCKS = 16  # in an Arrow batch
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

WORDS, PAIRS, BLOCK, TALLY_1, TALLY_2, TALLY_3 = range(6)  # kinds of packed rows of a part, in their order
CODED = "chunk long, words binary, octets binary, flat binary, marks binary, ids binary"
PACKED = "part int, kind int, chunk long, words binary, octets binary, grams binary, counts binary, docs binary, marks binary, ends binary"
MET = "shard int, part int, kind int, words binary, counts binary"


def _press(array: np.ndarray) -> bytes:
    """The bytes of the numbers, first those of one place, then those of the next, which makes small numbers small."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed_rows(rows: list[dict], schema: str = PACKED) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], types[kind]) for name, kind in fields],
                                      names=[name for name, _ in fields])


def _home(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(8)) % np.uint64(parts)


def _keys(u: np.ndarray, v: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of ``v, u`` and of ``v, u, w``, each below ``size``."""
    context = v * size + u
    if size >= KEY_KINDS:
        context = np.unique(context, return_inverse=True)[1]
    return context, context * size + w


def _log_weight(total: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Of contexts, from the sums of the counts and of what is cut from them; zero for those without counts."""
    return np.log(np.divide(free, total, out=np.ones(total.shape), where=total > 0))


def _log_p(below: np.ndarray, counts: np.ndarray, cut: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log probabilities of grams from their counts and weighted ones of the shorter grams."""
    some = counts > 0
    share = np.divide(counts - cut, total, out=np.zeros(cut.shape), where=some)
    return np.log(share + np.exp(below), out=below.copy(), where=some)


def _cut(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """For ``(n, FOLDS)`` counts what is taken off each; ``discounts`` has a row for each fold."""
    return np.stack([np.r_[0.0, discounts[f]][np.minimum(counts[:, f], 3)] for f in range(FOLDS)], axis=1)


class _Chunk:
    """Texts of a task as numbers of their words."""

    def __init__(self):
        self.numbers = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.flat, self.marks, self.ids = [], [], []  # of each text two starts, the words and an end
        self.size = 0

    def add(self, text: str, fold: int, trusted: bool, id_: bytes) -> None:
        words = WORD.findall(text)
        flat = np.zeros(len(words) + 3, np.int32)
        flat[2:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        flat[2:-1] += 2
        flat[-1] = 1
        self.flat.append(flat)
        self.marks.append(fold + 4 * trusted)
        self.ids.append(id_)
        self.size += len(flat)

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or len(self.numbers) >= CHUNK_KINDS

    def row(self) -> dict:
        coded = [x.encode("utf-8", "surrogatepass") for x in self.numbers]
        hashes = np.array([START, END, *map(xxhash.xxh64_intdigest, coded)], np.uint64).view(np.int64)
        octets = np.array([0, 0, *map(len, coded)], np.uint32)
        flat = np.concatenate(self.flat)
        often = np.argsort(-np.bincount(flat, minlength=len(hashes)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        return {"words": _press(hashes[often]), "octets": _press(octets[often]), "flat": _press(rank[flat]),
                "marks": _press(np.array(self.marks, np.uint8)), "ids": b"".join(self.ids)}


def code_texts(docs: DataFrame, trusted: Broadcast | None) -> DataFrame:
    """``CODED``, a row for each chunk, of the rows of ``text, fold, mark, id`` that have text.

    ``mark`` tells whether a row is trusted, or is what ``trusted`` may hold.
    """
    def worker(batches: Batches) -> Batches:
        serial, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                texts, folds, marks, ids = (some.column(c).to_pylist() for c in ("text", "fold", "mark", "id"))
                if trusted is not None:
                    at = np.searchsorted(trusted.value, np.array([m or 0 for m in marks], np.int64))
                    marks = [m is not None and k < len(trusted.value) and trusted.value[k] == m for m, k in zip(marks, at)]
                for text, fold, mark, id_ in zip(texts, folds, marks, ids):
                    if text:
                        chunk.add(text, fold, mark, id_)
                        if chunk.full():
                            yield _packed_rows([chunk.row() | {"chunk": serial}], CODED)
                            serial, chunk = serial + 1, _Chunk()
        if chunk.size:
            yield _packed_rows([chunk.row() | {"chunk": serial}], CODED)

    return docs.select("text", "fold", "mark", "id").mapInArrow(worker, CODED)


def _blocks(row: dict, parts: int, split: dict[int, int], round_: int, rounds: int, counting: bool) -> Iterator[dict]:
    """Packed rows of a chunk for the parts that are ``round_`` modulo ``rounds``: the trigrams of the documents in their order,
    or with ``counting`` those of trusted documents and the last words of all."""
    hashes, octets = _unpress(row["words"], np.int64), _unpress(row["octets"], np.uint32)
    flat, marks = _unpress(row["flat"], np.uint32).astype(np.int64), _unpress(row["marks"], np.uint8)
    start = np.flatnonzero(hashes == START)[0]
    begins = np.flatnonzero(flat == start)[::2]
    home = _home(hashes, parts).astype(np.int64)
    often = {np.flatnonzero(hashes == word)[0]: n for word, n in split.items() if (hashes == word).any()}
    wanted = home % rounds == round_
    wanted[list(often)] = True
    at = np.flatnonzero(wanted[flat[1:-1]] & (flat[2:] != start))  # of first words
    doc = np.repeat(np.arange(len(marks)), np.diff(np.r_[begins, len(flat)]))[at]
    u, v, w = flat[at], flat[at + 1], flat[at + 2]
    dealt = home[v]
    if often:
        for word, n in often.items():
            here = np.flatnonzero(v == word)
            dealt[here] = (dealt[here] + ((hashes[u[here]].view(np.uint64) >> np.uint64(16)) % np.uint64(n)).astype(np.int64)) % parts
        take = dealt % rounds == round_
        doc, u, v, w, dealt = (x[take] for x in (doc, u, v, w, dealt))
    some = np.arange(round_, parts, rounds)
    if counting:
        last_words = np.zeros((len(some), len(hashes)), bool)
        last_words[dealt // rounds, w] = True
        take = marks[doc] >= 4
        doc, u, v, w, dealt = (x[take] for x in (doc, u, v, w, dealt))
    dealt = dealt // rounds * SUBS + _sub(hashes)[v]
    order = np.argsort(dealt.astype(np.uint16 if len(some) * SUBS < 1 << 16 else np.int64), kind="stable")
    doc, u, v, w, dealt = (x[order] for x in (doc, u, v, w, dealt))
    bounds = np.searchsorted(dealt, np.arange(len(some) * SUBS + 1))
    for k, p in enumerate(some):
        subs = [slice(*bounds[j : j + 2]) for j in range(k * SUBS, (k + 1) * SUBS)]
        here = slice(subs[0].start, subs[-1].stop)
        also = np.flatnonzero(last_words[k]) if counting else np.zeros(0, np.int64)
        if here.start == here.stop and not len(also):
            continue
        used = np.zeros(len(hashes), bool)
        for x in (u[here], v[here], w[here], also):
            used[x] = True
        local = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
        grams = [_press(np.concatenate([local[u[x]], local[v[x]], local[w[x]]])) for x in subs]
        docs = [_press(np.diff(doc[x], prepend=0).astype(np.uint32)) for x in subs]
        ends = np.array([np.cumsum([len(x) for x in grams]), np.cumsum([len(x) for x in docs]), [x.stop - x.start for x in subs]])
        yield {"part": int(p), "kind": BLOCK, "chunk": row["chunk"], "words": _press(hashes[used]), "octets": _press(octets[used]),
               "grams": b"".join(grams), "docs": b"".join(docs), "marks": row["marks"], "ends": _press(ends.reshape(-1)),
               "counts": _press(local[also]) if counting else None}


def _sub(hashes: np.ndarray) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(40)) % np.uint64(SUBS)).astype(np.int64)


def _ends(row: dict) -> np.ndarray:
    """Where the packed trigrams of each sub of a block end, and where their documents, and how many there are."""
    return _unpress(row["ends"], np.int64).reshape(3, SUBS)


def _packed(coded: DataFrame, parts: int, split: dict[int, int], round_: int, rounds: int, counting: bool) -> DataFrame:
    """``PACKED`` for the chunks."""
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(batch.num_rows):
                for block in _blocks(batch.slice(k, 1).to_pylist()[0], parts, split, round_, rounds, counting):
                    yield _packed_rows([block])

    return coded.drop("ids").mapInArrow(worker, PACKED)


def _grouped(batches: Batches, by: str) -> Iterator[list[dict]]:
    """The rows of one part after the other; they are sorted by it."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[by] != held[-1][by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class _Slice:
    """The trigrams of some middle words of a part, the different ones in the order of ``v, u, w``.

    ``place`` has the different gram of each one, ``fold`` and ``trusted`` what its document is.  ``count`` finds the grams that
    are ``seen`` in trusted text, their counts ``c3`` without each fold, and ``c2``, those of all pairs ``v, w``.
    """

    def __init__(self, rows: list[dict], subs: range):
        self.chunks, named, octets, local, marks = [], [], [], [], []
        for row in rows:
            ends = _ends(row)
            some = [k for k in subs if ends[2, k]]
            if not some:
                continue
            begins = np.c_[[0, 0], ends[:2, :-1]]
            grams = np.concatenate([_unpress(row["grams"][begins[0, k] : ends[0, k]], np.uint32).reshape(3, -1) for k in some], axis=1)
            docs = [np.cumsum(_unpress(row["docs"][begins[1, k] : ends[1, k]], np.uint32).astype(np.int64)) for k in some]
            docs, of, words = np.concatenate(docs), _unpress(row["marks"], np.uint8), _unpress(row["words"], np.int64)
            self.chunks.append((row["chunk"], docs, len(of)))
            used = np.zeros(len(words), bool)
            used[grams.reshape(-1)] = True
            local.append((np.cumsum(used, dtype=np.int32) - 1)[grams])
            named.append(words[used])
            octets.append(_unpress(row["octets"], np.uint32)[used])
            marks.append(of[docs])
        marks = np.concatenate(marks)
        self.fold, self.trusted = (marks & 3).astype(np.int64), marks >= 4
        self.words = np.unique(np.concatenate(named))
        size = len(self.words)
        places = [np.searchsorted(self.words, x) for x in named]
        self.octets = np.zeros(size, np.int64)
        for place, x in zip(places, octets):
            self.octets[place] = np.maximum(self.octets[place], x)
        self.u, self.v, self.w = np.concatenate([place[x] for place, x in zip(places, local)], axis=1)
        context, key = _keys(self.u, self.v, self.w, size)
        at, self.place = _numbered(key)
        v, w, context = self.v[at], self.w[at], context[at]
        self.context = np.cumsum(np.r_[False, np.diff(context) != 0])
        at, self.pair = _numbered(v * size + w)
        self.pair_v, self.pair_w = v[at], w[at]

    def count(self) -> None:
        at = self.place[self.trusted] * FOLDS + self.fold[self.trusted]
        counts = np.bincount(at, minlength=len(self.pair) * FOLDS).reshape(-1, FOLDS)
        self.seen = np.flatnonzero(counts.any(axis=1))
        counts = counts[self.seen]
        self.c3 = counts.sum(axis=1, keepdims=True) - counts
        self.c2 = _sums(self.pair[self.seen], self.c3 > 0, len(self.pair_v)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key is found, in their order, and the number of every key among them."""
    order = np.argsort(keys)
    first = np.ones(len(order), bool)
    first[1:] = np.diff(keys[order]) != 0
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """``(size, FOLDS)``: the rows of values added up by the numbers in ``at``."""
    return np.stack([np.bincount(at, values[:, f], size) for f in range(FOLDS)], axis=1)


def _slices(rows: list[dict]) -> Iterator[_Slice]:
    sizes = sum((_ends(r)[2] for r in rows), np.zeros(SUBS, np.int64))
    start = 0
    for k in range(SUBS):
        if k == SUBS - 1 or sizes[start : k + 2].sum() > SLICE_GRAMS:
            if sizes[start : k + 1].any():
                yield _Slice(rows, range(start, k + 1))
            start = k + 1


def _tallies(counts: np.ndarray) -> np.ndarray:
    """``(6, FOLDS)``: how many counts are one, two, three, four, how many there are, and their sum."""
    return np.stack([*[(counts == k).sum(axis=0) for k in (1, 2, 3, 4)], (counts > 0).sum(axis=0), counts.sum(axis=0)]).astype(np.int64)


def _shards(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where the words of each shard are."""
    shard = ((hashes.view(np.uint64) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield int(k), order[bounds[k] : bounds[k + 1]]


def count_parts(blocks: DataFrame, split: dict[int, int], parts: int) -> DataFrame:
    """``MET``, packed by shards of last words: those of each part with the number of different words before them, and the pairs
    of split words with those before them; tallies of the other counts."""
    def worker(batches: Batches) -> Batches:
        hot = np.array(list(split), np.int64)
        for rows in _grouped(batches, "part"):
            part = rows[0]["part"]
            words = np.unique(np.concatenate([_unpress(r["words"], np.int64)[_unpress(r["counts"], np.uint32)] for r in rows]))
            before = np.zeros((len(words), FOLDS), np.int64)
            tally = {TALLY_2: np.zeros((6, FOLDS), np.int64), TALLY_3: np.zeros((6, FOLDS), np.int64)}
            for found in _slices(rows):
                found.count()
                whole = ~np.isin(found.words, hot)[found.pair_v]
                tally[TALLY_3] += _tallies(found.c3)
                tally[TALLY_2] += _tallies(found.c2[whole])
                at = np.searchsorted(words, found.words[found.pair_w[whole]])
                before += _sums(at, found.c2[whole] > 0, len(words)).astype(np.int64)
                if not whole.all():
                    v, w, n = found.words[found.pair_v[~whole]], found.words[found.pair_w[~whole]], found.c2[~whole]
                    yield _packed_rows([{"shard": k, "part": part, "kind": PAIRS, "words": _press(np.concatenate([v[at], w[at]])),
                                         "counts": _press(n[at].reshape(-1))} for k, at in _shards(w, parts)], MET)
            yield _packed_rows([{"shard": k, "part": part, "kind": WORDS, "words": _press(words[at]),
                                 "counts": _press(before[at].reshape(-1))} for k, at in _shards(words, parts)], MET)
            yield _packed_rows([{"shard": 0, "part": part, "kind": k, "counts": _press(n.reshape(-1))} for k, n in tally.items()], MET)

    return blocks.mapInArrow(worker, MET)


def meet_parts(counts: DataFrame, split: dict[int, int], parts: int) -> DataFrame:
    """``PACKED``: the counts of ``MET`` added up, for each part that needs them, and tallies of them."""
    def worker(batches: Batches) -> Batches:
        for rows in _grouped(batches, "shard"):
            blocks = [(r["part"], _unpress(r["words"], np.int64), _unpress(r["counts"], np.int64).reshape(-1, FOLDS))
                      for r in rows if r["kind"] == WORDS]
            words = np.unique(np.concatenate([b[1] for b in blocks]))
            places = [np.searchsorted(words, b[1]) for b in blocks]
            before = _sums(np.concatenate(places), np.concatenate([b[2] for b in blocks]), len(words)).astype(np.int64)
            tally = {}
            pairs = [r for r in rows if r["kind"] == PAIRS]
            if pairs:
                v, w, n = _unpacked_counts(pairs)
                order = np.lexsort((w, v))
                v, w = v[order], w[order]
                first = np.flatnonzero(np.r_[True, (np.diff(v) != 0) | (np.diff(w) != 0)])
                v, w, n = v[first], w[first], np.add.reduceat(n[order], first, axis=0)
                before += _sums(np.searchsorted(words, w), n > 0, len(words)).astype(np.int64)
                tally[TALLY_2] = _tallies(n)
                for word in np.unique(v):
                    at = v == word
                    row = {"kind": PAIRS, "words": _press(np.concatenate([v[at], w[at]])), "counts": _press(n[at].reshape(-1))}
                    home = int(_home(np.array([word]), parts)[0])
                    yield _packed_rows([row | {"part": (home + k) % parts} for k in range(split[int(word)])])
            tally[TALLY_1] = _tallies(before)
            for (part, names, _), place in zip(blocks, places):
                known = before[place].any(axis=1)
                yield _packed_rows([{"part": part, "kind": WORDS, "words": _press(names[known]), "counts": _press(before[place[known]].reshape(-1))}])
            yield _packed_rows([{"part": 0, "kind": k, "counts": _press(n.reshape(-1))} for k, n in tally.items()])

    dealt = counts.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(worker, PACKED)


def _discounts(tally: np.ndarray) -> np.ndarray:
    """For each fold those of counts of one, two, three and more; ``tally`` is that of ``_tallies``."""
    out = []
    for n1, n2, n3, n4 in tally[:4].T.astype(float).tolist():
        if not (n1 and n2):
            out.append([0.5, 0.5, 0.5])
            continue
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        out.append([min(max(d, 0.05), k) for d, k in zip(found, (0.95, 1.9, 2.9))])
    return np.array(out)


def _unpacked_counts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last words of pairs, or twice the words, and their counts."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FOLDS), np.int64)
    counts = [_unpress(r["counts"], np.int64).reshape(-1, FOLDS) for r in rows]
    names = [_unpress(r["words"], np.int64) for r in rows]
    return (np.concatenate([x[: len(n)] for x, n in zip(names, counts)]),
            np.concatenate([x[len(x) - len(n) :] for x, n in zip(names, counts)]), np.concatenate(counts))


def score_parts(rows: DataFrame, split: dict[int, int], cuts: dict[int, np.ndarray], singles: np.ndarray) -> DataFrame:
    """``chunk, data``: what each part adds to the log likelihood of the documents of a chunk."""
    def worker(batches: Batches) -> Batches:
        hot = np.array(list(split), np.int64)
        for held in _grouped(batches, "part"):
            of = {k: [r for r in held if r["kind"] == k] for k in (WORDS, PAIRS, BLOCK)}
            _, words, c1 = _unpacked_counts(of[WORDS])
            pairs = _unpacked_counts(of[PAIRS])
            sums = {}
            for here in _slices(of[BLOCK]):
                here.count()
                found, start = _log_likelihoods(here, hot, cuts, singles, (words, c1), pairs), 0
                for chunk, docs, n in here.chunks:
                    total = sums.setdefault(chunk, np.zeros(n))
                    total += np.bincount(docs, found[start : start + len(docs)], n)
                    start += len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                             names=["chunk", "data"])

    return rows.mapInArrow(worker, "chunk long, data binary")


def _rows(at: np.ndarray, size: int) -> np.ndarray:
    """The place in ``at`` of each number below ``size``, or -1."""
    out = np.full(size, -1)
    out[at] = np.arange(len(at))
    return out


def _log_likelihoods(here: _Slice, hot: np.ndarray, cuts: dict[int, np.ndarray], singles: np.ndarray, words, pairs) -> np.ndarray:
    """Log probability of the last word of each trigram; ``singles`` has a row of sums of counts and one of cuts.

    What words without a count share is the discounted mass of the single words; it is spelled out, all octets and the
    end of a word alike, so the probabilities of all strings sum to one.
    """
    size = len(here.words)
    at, known = here.find(words[0])
    at, counts = at[known], words[1][known]
    p1 = np.where(here.words == END, 1, here.octets + 1)[:, None] * -np.log(257.0) + _log_weight(*singles)
    p1[at] = _log_p(p1[at], counts, _cut(counts, cuts[1]), singles[0])

    split = np.isin(here.words, hot)
    if split.any():  # their pairs lie in several parts
        here.c2[split[here.pair_v]] = 0
        v, known = here.find(pairs[0])
        w, known_w = here.find(pairs[1])
        key, keys = v * size + w, here.pair_v * size + here.pair_w
        to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        met = known & known_w & (keys[to] == key)
        here.c2[to[met]] = pairs[2][met]
    seen = np.flatnonzero(here.c2.any(axis=1))
    counts, v = here.c2[seen], here.pair_v[seen]
    cut = _cut(counts, cuts[2])
    total, free = _sums(v, counts, size), _sums(v, cut, size)
    if split.any():
        at, whole = here.find(pairs[0])[0][known], pairs[2][known]
        total[split], free[split] = _sums(at, whole, size)[split], _sums(at, _cut(whole, cuts[2]), size)[split]
    weight2 = _log_weight(total, free)
    p2 = _log_p(p1[here.pair_w[seen]] + weight2[v], counts, cut, total[v])
    pair_rows = _rows(seen, len(here.pair_v))

    cut = _cut(here.c3, cuts[3])
    at, context = _numbered(here.context[here.seen])
    total, free = _sums(context, here.c3, len(at)), _sums(context, cut, len(at))
    weight3 = _log_weight(total, free)
    p3 = _log_p(p2[pair_rows[here.pair[here.seen]]] + weight3[context], here.c3, cut, total[context])
    context_rows = _rows(here.context[here.seen[at]], here.context[-1] + 1)

    out = p1[here.w, here.fold] + weight2[here.v, here.fold]
    for rows, values, add in ((pair_rows[here.pair], p2, False), (context_rows[here.context], weight3, True),
                              (_rows(here.seen, len(here.pair)), p3, False)):
        row = rows[here.place]
        some = np.flatnonzero(row >= 0)
        found = values[row[some], here.fold[some]]
        out[some] = out[some] + found if add else found
    return out


def _chunk_sums(rows: DataFrame) -> DataFrame:
    """``chunk, data``: the rows of each chunk added up."""
    def worker(batches: Batches) -> Batches:
        def out(chunk, total):
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "data"])

        chunk, total = None, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                if chunk is not None and row["chunk"] != chunk:
                    yield out(chunk, total)
                    total = 0.0
                chunk, total = row["chunk"], total + np.frombuffer(row["data"])
        if chunk is not None:
            yield out(chunk, total)

    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(worker, "chunk long, data binary")


def _document_sums(rows: DataFrame) -> DataFrame:
    """``id, log_likelihood`` for each document of the rows of ``ids, data``."""
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                ids = [row["ids"][k : k + 33] for k in range(0, len(row["ids"]), 33)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(np.frombuffer(row["data"]))],
                                                 names=["id", "log_likelihood"])

    return rows.mapInArrow(worker, "id binary, log_likelihood double")


def frequent_words(docs: DataFrame, size: int, parts: int) -> dict[int, int]:
    """Words that are more than half of an average part, in a sample of the texts, and over how many parts they are dealt."""
    def worker(batches: Batches) -> Batches:
        counts = defaultdict(int)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in WORD.findall(text or ""):
                    counts[word] += 1
        names = [START, *(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in counts)]  # START: all of them
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)),
                                          pa.array([sum(counts.values()), *counts.values()], pa.int64())], names=["word", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // SAMPLE_BYTES))) == 0)
    found = sample.select("text").mapInArrow(worker, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = {r.word: r.n for r in found.orderBy(F.desc("n"), F.col("word") != START).limit(2 * parts + 1).collect()}
    whole = most.pop(START, 0)
    return {word: min(parts, -(-2 * parts * n // whole)) for word, n in most.items() if 2 * parts * n > whole}


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score_words(docs: DataFrame, trusted_ids: DataFrame, scratch: Scratch, parts: int | None = None,
                rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, lang, perplexity`` for each row of ``doc_id, lang, text``.

    The perplexity is that for each octet of the whole text, null for empty texts.
    """
    spark = docs.sparkSession
    with _set(spark, CLEAN_UP, "true"):  # files of a shuffle go when its query ends, not when the driver collects garbage
        sums = _score(docs, trusted_ids, scratch, parts, rounds)
    # Documents with one text and fold have one score, so a document finds it by them: ids may repeat or be null.
    size = F.octet_length("text")
    heads = docs.select("doc_id", "lang", size.alias("size"), F.when(size > 0, _identity()).alias("id"))
    return heads.join(sums, "id", "left").select(
        "doc_id", "lang", F.when(F.col("size") > 0, F.exp(-F.col("log_likelihood") / F.col("size"))).alias("perplexity")
    )


def _fold():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def _identity():
    return F.concat(F.unhex(F.sha2("text", 256)), F.unhex(F.lpad(F.hex(_fold()), 2, "0")))


def _marked(docs: DataFrame, trusted_ids: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """``text, fold, id, mark`` of each row; no text is shuffled while the tasks may have the hashes of the trusted ids."""
    named = docs.select("doc_id", "text", _fold().alias("fold"), _identity().alias("id"))
    ids = trusted_ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    if ids.count() > TRUSTED_IDS:
        found = named.join(ids.withColumn("mark", F.lit(True)).hint("merge"), "doc_id", "left")
        return found.withColumn("mark", F.col("mark").isNotNull()), None
    hashes = np.sort(ids.select(F.xxhash64("doc_id").alias("hash")).toArrow()["hash"].to_numpy())  # counted above
    mark = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return named.withColumn("mark", mark), docs.sparkSession.sparkContext.broadcast(hashes)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def _score(docs: DataFrame, trusted_ids: DataFrame, scratch: Scratch, parts: int | None, rounds: int) -> DataFrame:
    """``id, log_likelihood`` for each different text and fold."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rounds = min(rounds, size // ROUND_BYTES + 1)
    cores = spark.sparkContext.defaultParallelism
    parts = parts or max(2 * cores, rounds * cores, size // PART_BYTES + 1)
    rounds = min(rounds, parts)
    split = frequent_words(docs, size, parts)
    coded = stored(code_texts(*_marked(docs, trusted_ids)), scratch, "coded")
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_OF_BLOCKS)):
        return _score_coded(coded, split, scratch, parts, rounds)


def _score_coded(coded: DataFrame, split: dict[int, int], scratch: Scratch, parts: int, rounds: int) -> DataFrame:
    spark = coded.sparkSession
    for r in range(rounds):
        blocks = _dealt(_packed(coded, parts, split, r, rounds, True), parts)
        stored(count_parts(blocks, split, parts), scratch, f"found-{r}")
    found = spark.read.schema(MET).parquet(*[scratch.path(f"found-{r}") for r in range(rounds)])
    given = stored(meet_parts(found.where(F.col("kind") <= PAIRS), split, parts), scratch, "given")
    tally = {k: np.zeros((6, FOLDS), np.int64) for k in (TALLY_1, TALLY_2, TALLY_3)}
    for table in (found, given):  # a few numbers for each part
        for row in table.where(F.col("kind") >= TALLY_1).select("kind", "counts").collect():
            tally[row.kind] += _unpress(bytes(row.counts), np.int64).reshape(6, FOLDS)
    cuts = {k: _discounts(t) for k, t in zip((1, 2, 3), (tally[TALLY_1], tally[TALLY_2], tally[TALLY_3]))}
    one, two, _, _, some, total = tally[TALLY_1]
    singles = np.stack([total.astype(float), (np.stack([one, two, some - one - two]) * cuts[1].T).sum(axis=0)])
    scratch.drop(*[f"found-{r}" for r in range(rounds)])

    for r in range(rounds):
        blocks = _packed(coded, parts, split, r, rounds, False)
        rows = _dealt(blocks.unionByName(given.where((F.col("kind") < BLOCK) & (F.col("part") % rounds == r))), parts)
        stored(_chunk_sums(score_parts(rows, split, cuts, singles)), scratch, f"sums-{r}")
    sums = _chunk_sums(spark.read.schema("chunk long, data binary").parquet(*[scratch.path(f"sums-{r}") for r in range(rounds)]))
    sums = stored(_document_sums(coded.select("chunk", "ids").join(sums.hint("merge"), "chunk")), scratch, "sums")
    scratch.drop("coded")
    return sums.groupBy("id").agg(F.max("log_likelihood").alias("log_likelihood"))
