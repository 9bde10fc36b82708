"""Variant spellings: words that differ by one inserted, deleted or replaced letter, found in frequency-vector tries.

The letters are cut into groups, and a word is the vector of its counts in them.  One replaced letter moves at most one
count up and one down, one inserted letter moves one up: a surplus and a deficit of one each.  A trie holds words of one
length by their successive counts; the search for a word goes down it depth first and spends that budget where it leaves
the word's own counts.  Words at the leaves are compared letter by letter.

The tries are the tasks' shards: words are dealt by their length and their counts in the first groups, as many groups as
it takes until no shard is large.  A word is sent, as a question, to every shard within its budget.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.rows import Batches, stored, utf8
from murmuration.sources.scratch import Scratch

LEAST_LENGTH, LEAST_COUNT, CHANGED_EVERY = 5, 3, 97
# Groups of letters from the frequent to the rare ones; all other letters are the last group.
GROUPS = ("e", "a", "i", "n", "o", "r", "t", "s", "l", "u", "d", "h", "cm", "pg", "bfv", "wyk", "jqxz")
GROUP_OF = np.full(256, len(GROUPS), np.uint8)
for _number, _letters in enumerate(GROUPS):
    GROUP_OF[np.frombuffer(_letters.encode("latin-1"), np.uint8)] = _number
SHARD_WORDS = 50_000
MOST_GROUPS = 5  # that shards are dealt by: 12 bits of a code each
HELD = 1 << 18
FRONTIER = 1 << 20  # nodes, and pairs of words, that are looked at together
ROUTED = "length int, code long, asks boolean, word string, n long"


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, some with a letter left out, that are long and frequent enough."""
    run = f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"

    def worker(batches: Batches) -> Batches:
        found, crc32, held = re.compile(run).findall, zlib.crc32, {}
        get = held.get

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for id_, t in zip(batch.column("id").to_pylist(), utf8(batch, "text")):
                start = crc32(f"{id_}:".encode())
                for w, n in Counter(found((t or b"").lower().decode())).items():
                    h = crc32(w.encode(), start)
                    if not h % CHANGED_EVERY:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < LEAST_LENGTH:
                            continue
                    held[w] = get(w, 0) + n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(worker, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Counts in each group, for words of one length as rows of Latin-1 codes."""
    groups = GROUP_OF[letters]
    return np.stack([(groups == g).sum(axis=1) for g in range(len(GROUPS) + 1)], axis=1).astype(np.int32)


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in the list and letters of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(len(at), length)


def _code(counts: np.ndarray) -> np.ndarray:
    code = np.zeros(len(counts), np.int64)
    for column in counts.T:
        code = code << 12 | np.minimum(column, 4095)
    return code


def route(words: DataFrame, groups: int, asks: bool = True) -> DataFrame:
    """``ROUTED``: each word at its own shard and, if it ``asks``, at the later ones that may hold near words.

    Of two shards of equal length the one with the higher code is asked, and words ask for longer ones: every pair of
    near words meets once.
    """
    none = np.zeros(groups, np.int32)
    unit = np.eye(groups, dtype=np.int32)
    swaps = [*unit, *-unit, *[unit[i] - unit[j] for i in range(groups) for j in range(groups) if i != j]]

    def worker(batches: Batches) -> Batches:
        for batch in batches:
            spelled = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            for length, at, letters in _by_length(spelled):
                counts = vectors(letters)[:, :groups]
                own = _code(counts)
                sent = [(np.full(len(at), length), own, False, at)]
                if asks:
                    for step in swaps:
                        code = _code(counts + step)
                        go = ((counts + step) >= 0).all(axis=1) & (code > own)
                        sent.append((np.full(go.sum(), length), code[go], True, at[go]))
                    sent += [(np.full(len(at), length + 1), _code(counts + step), True, at) for step in (none, *unit)]
                rows = np.concatenate([s[3] for s in sent])
                columns = [pa.array(np.concatenate([s[0] for s in sent]), pa.int32()), pa.array(np.concatenate([s[1] for s in sent])),
                           pa.array(np.repeat([s[2] for s in sent], [len(s[3]) for s in sent]))]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*columns, taken.column("word"), taken.column("n")], names=["length", "code", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(worker, ROUTED)


class FrequencyTrie:
    """Words of one length.  A node is a run of the sorted vectors; per level a table leads to the child of each count."""

    def __init__(self, letters: np.ndarray):
        self.length = letters.shape[1]
        counts = vectors(letters)
        self.order = np.lexsort(counts.T[::-1])
        self.letters = letters[self.order]
        counts = counts[self.order]
        differs = counts[1:] != counts[:-1]
        opens = np.r_[True, differs.any(axis=1)]
        self.leaf_start = np.r_[np.flatnonzero(opens), len(counts)]
        leaves, apart = counts[opens], np.zeros(int(opens.sum()), bool)
        apart[0] = True
        node = np.zeros(len(leaves), np.int64)
        self.tables, self.ranks = [], []
        for level in range(leaves.shape[1]):
            present, rank = np.unique(leaves[:, level], return_inverse=True)
            apart[1:] |= leaves[1:, level] != leaves[:-1, level]
            child = np.cumsum(apart) - 1
            table = np.full((node[-1] + 1, len(present) + 1), -1, np.int32)
            table[node, rank] = child
            to_rank = np.full(self.length + 4, len(present), np.int32)  # counts of no child lead nowhere
            to_rank[present] = np.arange(len(present))
            self.tables.append(table)
            self.ranks.append(to_rank)
            node = child

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of ``asked``, row of the trie in sorted order) of words at distance one.

        ``asked`` are words of the same length, or one shorter: then there is no deficit to spend.
        """
        wanted = vectors(asked)
        levels = len(self.tables)
        spent = 0 if asked.shape[1] == self.length else 2  # bits: 1 the surplus, 2 the deficit
        start = np.arange(len(asked))
        stack = [(0, start, np.zeros(len(asked), np.int64), np.full(len(asked), spent, np.int8))]
        while stack:
            level, who, node, used = stack.pop()
            if level == levels:
                yield from self._verify(asked, who, node)
                continue
            if len(who) > FRONTIER // 4:
                half = len(who) // 2
                stack += [(level, who[half:], node[half:], used[half:]), (level, who[:half], node[:half], used[:half])]
                continue
            table, rank, count = self.tables[level], self.ranks[level], wanted[who, level]
            found = []
            for step, bit in ((0, 0), (1, 1), (-1, 2)):
                open_ = np.flatnonzero((used & bit == 0) & (count + step >= 0)) if bit else slice(None)
                to = table[node[open_], rank[count[open_] + step]]
                there = to >= 0
                found.append((who[open_][there], to[there], used[open_][there] | np.int8(bit)))
            who, node, used = (np.concatenate(c) for c in zip(*found))
            if len(who):
                stack.append((level + 1, who, node, used))

    def _verify(self, asked: np.ndarray, who: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = self.leaf_start[leaf + 1] - self.leaf_start[leaf]
        ends = np.cumsum(size)
        most = max(1, FRONTIER // max(1, self.length // 16))
        first = 0
        while first < int(ends[-1]):
            flat = np.arange(first, min(first + most, int(ends[-1])))
            pair = np.searchsorted(ends, flat, side="right")
            mine, other = who[pair], self.leaf_start[leaf[pair]] + flat - (ends - size)[pair]
            first = int(flat[-1]) + 1
            a, b = asked[mine], self.letters[other]
            if a.shape[1] == b.shape[1]:
                near = (a != b).sum(axis=1) == 1
            else:
                head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(axis=1)
                tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
                near = head + tail >= a.shape[1]
            if near.any():
                yield mine[near], other[near]


def near_words(routed: DataFrame, partitions: int) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of near words, one shard after the other in each task."""
    def worker(batches: Batches) -> Batches:
        key, held, trie, numbers, names = None, [], None, None, None

        def pairs(asked: list[bytes], n: np.ndarray, own: bool) -> Batches:
            for _, at, letters in _by_length(asked):
                for mine, other in trie.search(letters):
                    other = trie.order[other]
                    if own:  # both directions come by themselves
                        mine = at[mine]
                        a, b, m = mine, other, numbers[other]
                        yield out([names[k] for k in a], [names[k] for k in b], m)
                    else:
                        mine = at[mine]
                        left, right = [asked[k] for k in mine], [names[k] for k in other]
                        yield out(left + right, right + left, np.concatenate([numbers[other], n[mine]]))

        def out(word: list[bytes], near: list[bytes], near_n: np.ndarray) -> pa.RecordBatch:
            texts = [pa.array([w.decode("latin-1") for w in c], pa.string()) for c in (word, near)]
            return pa.RecordBatch.from_arrays([*texts, pa.array(near_n)], names=["word", "near", "near_n"])

        def close() -> Batches:
            """All words of the shard are there."""
            nonlocal trie, numbers, names, held
            names = [w for words, _ in held for w in words]
            numbers = np.concatenate([n for _, n in held]) if held else np.zeros(0, np.int64)
            held = []
            if names:
                trie = FrequencyTrie(np.frombuffer(b"".join(names), np.uint8).reshape(len(names), -1))
                yield from pairs(names, numbers, True)

        opened = False
        for batch in batches:
            length, code, asks, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "code", "asks", "n"))
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            change = np.flatnonzero((np.diff(length) != 0) | (np.diff(code) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(words)]):
                if a == b:
                    continue
                if (length[a], code[a]) != key:
                    if opened:
                        yield from close()
                    key, opened, trie = (length[a], code[a]), True, None
                if not asks[a]:
                    held.append((words[a:b], n[a:b]))
                    continue
                if opened:
                    yield from close()
                    opened = False
                if trie is not None:
                    yield from pairs(words[a:b], n[a:b], False)
        if opened:
            yield from close()

    dealt = routed.repartition(partitions, "length", "code").sortWithinPartitions("length", "code", "asks")
    return dealt.mapInArrow(worker, "word string, near string, near_n long")


def deal(words: DataFrame, shard_words: int = SHARD_WORDS) -> int:
    """The number of groups that shards are dealt by: the least one without a shard of more than ``shard_words`` words."""
    for groups in range(1, MOST_GROUPS + 1):
        largest = route(words, groups, asks=False).groupBy("length", "code").count().agg(F.max("count")).first()[0]
        if (largest or 0) <= shard_words:
            break
    return groups


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for ``word, form``: forms of forms are followed to the last by doubling, each round a stored table."""
    current, k, moved = stored(forms.select("word", F.col("form").alias("root")), scratch, "roots-0"), 0, 1
    while moved:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        k += 1
        joined = stored(current.join(onward.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ), scratch, f"roots-{k}")
        moved = joined.where("moved").count()
        current = joined.select("word", "root")
    return current


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs``.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where 97 divides the crc32 of ``<id>:<run>`` it
    loses one letter.  Words of at least five letters and three occurrences ``n`` over all rows count.  Near words differ
    by one inserted, deleted or replaced letter.  ``form`` is the near word with the largest ``n``, the first one in code
    point order of equals, if that is at least twice the word's own; otherwise null, as ``form_n``.  ``root`` is the last
    form of forms, or the word.

    Null and empty texts have no words; a null id reads as empty; rows with equal ids all count; an empty table has no
    words; other columns are not read.  Runs of any length are whole words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    words = stored(count_words(docs, text, doc_id), scratch, "words")
    n_words = words.count()
    groups = deal(words, shard_words)
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(at_least, n_words * (groups + 1) ** 2 // 1_000_000)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_words(route(words, groups), partitions).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.near_n") >= 2 * F.col("n")
    found = stored(words.join(near.hint("merge"), "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near_n")).alias("form_n"),
    ), scratch, "forms")
    last = roots(found.where("form IS NOT NULL"), scratch)
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
