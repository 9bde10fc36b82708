"""Collocations: phrases of two to four words, counted by double-array tries of candidates.

Candidates are safe in the manner of Apriori: a frequent phrase has frequent parts.  Words are counted first; then tasks
sum the hashes of neighbouring frequent words, and of three and four words whose pairs survive.  A hash stands for all
phrases that share it, so its sum is never below the count of a phrase, and what is below the least count can go.  What
the tasks need to know of the survivors is a bitmap of a fixed size.  Texts are read once and stored as numbers of words.  The phrases behind the surviving hashes are dealt to
shards; each shard is a double-array trie of bounded size that goes to the tasks, which advance the states of all
positions of the text level by level and count accepting states.  Counts are summed over tasks; they are exact, whatever
the hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.rows import Batches, rows_of_a_batch, stored
from murmuration.sources.scratch import Scratch

LONGEST = 4
CHUNK = 1 << 20  # bytes of text that are Python objects at once
CHUNKS_HELD = 16  # texts of languages that wait for the rest of their chunk, in chunks
TEXTS_AT_ONCE, CHUNKS_AT_ONCE = 500, 4  # rows that go to a worker together; one of the latter takes about a megabyte
ROWS_OUT = 1 << 16  # of a batch that comes back
HELD = 1 << 21  # hashes, and words, that a task combines at once
BITS = 1 << 27  # of a bitmap of hashes: 16 MB at most at every size of the corpus
SHARD_PHRASES = 1 << 18
WINDOW = 4096  # cells that are tried together
END = b"\xff"  # of a piece; no byte of UTF-8
_FROM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09"
TABLE = bytes.maketrans(_FROM, b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
CHUNKS = "lang string, words binary, ids binary"
FOUND = "lang string, phrase string, hash long, n long"
TRIE = ("shard int, langs array<string>, words array<string>, base binary, check binary, accept binary, "
        "phrases array<struct<lang: string, phrase: string>>")


def token_lists(batches: Batches) -> Iterator[tuple[str, list[bytes]]]:
    """``lang`` and words in order, with ``END`` between pieces, of the rows of ``lang, text``, some pieces at a time.

    Texts of a language wait for others, also of later batches, until they make a chunk.
    """
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def cut_up(lang: str) -> Iterator[tuple[str, list[bytes]]]:
        sizes.pop(lang)
        data, start = END.join(held.pop(lang)).translate(TABLE), 0
        while start < len(data):
            cut = data.find(END, start + CHUNK)
            cut = len(data) if cut < 0 else cut
            yield lang, data[start:cut].replace(END, b" \xff ").split()
            start = cut + 1

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        kind = pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary()
        for lang, text in zip(langs, batch.column("text").cast(kind)):
            held.setdefault(lang, []).append(text.as_py() or b"")
            sizes[lang] += len(held[lang][-1]) + 1
            if sizes[lang] > CHUNK:
                yield from cut_up(lang)
            elif sizes.total() > CHUNKS_HELD * CHUNK:
                yield from cut_up(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from cut_up(lang)


def released(worker):
    """``worker`` that gives memory back at the end of a task: the process serves other tasks."""
    def run(batches: Batches) -> Batches:
        yield from worker(batches)
        pa.default_memory_pool().release_unused()

    return run


def slices(columns: dict[str, pa.Array]) -> Batches:
    batch = pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
    for start in range(0, batch.num_rows, ROWS_OUT):
        yield batch.slice(start, ROWS_OUT)


def from_chunks(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df``, which reads the chunks, as a table.  A worker has a few of them at once, however many its task reads."""
    with rows_of_a_batch(df.sparkSession, CHUNKS_AT_ONCE):
        return stored(df, scratch, name)


def named(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def count_words(chunks: DataFrame, min_count: int) -> DataFrame:
    """``lang, word, n`` of words with at least ``min_count`` occurrences, and the sum over all words under a null word."""
    def worker(batches: Batches) -> Batches:
        held: dict[str, dict[bytes, int]] = {}
        totals: Counter = Counter()

        def flush() -> Batches:
            while held:
                lang, words = held.popitem()
                counts = pa.array(words.values(), pa.int64())
                names = pa.array(words, pa.binary()).cast(pa.string())
                del words
                yield from slices({"lang": pa.repeat(lang, len(names)), "word": names, "n": counts})
            langs, counts = pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())
            totals.clear()
            yield from slices({"lang": langs, "word": pa.nulls(len(langs), pa.string()), "n": counts})

        for lang, words, ids in chunk_rows(batches):
            mine = held.setdefault(lang, {})
            get = mine.get
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            for w, n in zip(words, counts.tolist()):
                mine[w] = get(w, 0) + n
            totals[lang] += int(counts.sum())
            if sum(map(len, held.values())) >= HELD // 4:
                del mine, get
                yield from flush()
        yield from flush()

    counted = chunks.mapInArrow(released(worker), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | F.col("word").isNull())


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode()))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    own = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(own)), np.uint64, len(words))


def hashed_words(words: DataFrame) -> DataFrame:
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())
            hashes = np.array([word_hash(lang, w.encode()) for lang, w in pairs], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    return words.select("lang", "word").mapInArrow(released(worker), "hash long")


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that goes on with another word."""
    with np.errstate(over="ignore"):
        x = (before ^ (before >> np.uint64(29))) * _ODD[0] + word
        x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    # 48 bits: neighbours in order share most of their bytes in a shuffle.  Equal hashes only let more phrases through.
    return (x ^ (x >> np.uint64(31))) >> np.uint64(16)


def bitmap(hashes: DataFrame, most_bits: int = BITS) -> Broadcast:
    """One bit for each ``hash`` modulo the number of bits, in 64-bit words; gathered as words that are not zero.

    There are about 64 bits for each hash, but never more than ``most_bits``.
    """
    bits = max(64, min(most_bits, 1 << (64 * hashes.count()).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    found = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(words) - 1)
    return words[(place >> np.uint64(6)).astype(np.int64)] >> (hashes & np.uint64(63)) & np.uint64(1) == 1


class Words(dict):
    """Numbers of words in the order of their first use."""

    def __init__(self):
        self.names = []

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        self.names.append(word)
        return self[word]


def packed(places: np.ndarray) -> bytes:
    """Places from -1 on, the lowest bytes of all of them first: the higher ones are mostly zeros."""
    return (places + 1).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel() - 1


def encode(texts: DataFrame) -> DataFrame:
    """``CHUNKS``: some pieces of text as places in their own list of words, with -1 between pieces."""
    def worker(batches: Batches) -> Batches:
        known: dict[str, Words] = {}
        for lang, tokens in token_lists(batches):
            if sum(map(len, known.values())) > HELD // 8:
                known.clear()
            mine = known.setdefault(lang, Words())
            number = np.fromiter(map(mine.__getitem__, tokens), np.int64, len(tokens))
            present = np.zeros(len(mine) + 1, bool)
            present[number] = True
            if END in mine:
                present[mine[END]] = False
            here = np.flatnonzero(present)
            place = np.where(present, np.cumsum(present) - 1, -1).astype(np.int32)
            row = [lang, b" ".join([mine.names[k] for k in here]), packed(place[number])]
            kinds = pa.string(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["lang", "words", "ids"])

    return texts.mapInArrow(released(worker), CHUNKS)


def chunk_rows(batches: Batches) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """``lang``, words and the places in their list."""
    for batch in batches:
        for lang, words, ids in zip(*(batch.column(c) for c in ("lang", "words", "ids"))):
            yield lang.as_py(), words.as_py().split(), unpacked(ids.as_buffer())


def survivors(hashes: np.ndarray, ids: np.ndarray, bitmaps: list[np.ndarray], longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For k = 1 ... ``longest``: hash of the k words from each position on, and whether they may be frequent.

    Where no bitmap (the first is that of words) tells of k words, it is asked of both their parts of k - 1 words.
    """
    hashes = np.append(hashes, np.uint64(0))  # of the place -1
    frequent = _marked(bitmaps[0], hashes)
    frequent[-1] = False
    word, ok = hashes[ids], [frequent[ids]]
    found = [word]
    for k in range(2, longest + 1):
        if len(word) < k:
            break
        found.append(chained(found[-1][:-1], word[k - 1 :]))
        may = ok[-1][:-1] & ok[-1][1:]
        if k <= len(bitmaps):
            may[may] = _marked(bitmaps[k - 1], found[-1][may])
        ok.append(may)
    return found, ok


def find_phrases(chunks: DataFrame, bitmaps: list[Broadcast], min_count: int, names: bool = True, sums: bool = True) -> DataFrame:
    """``FOUND`` from the bitmaps of the hashes of 1, 2, 3 ... words: the different phrases that the last of them lets
    through, and for phrases of one word more the sums of their hashes that reach ``min_count``."""
    named = len(bitmaps)

    def worker(batches: Batches) -> Batches:
        held, seen, waiting = [], {}, 0
        known = [b.value for b in bitmaps]

        def summed() -> Batches:
            hashes = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            hashes.sort()
            opens = np.ones(len(hashes), bool)
            np.not_equal(hashes[1:], hashes[:-1], out=opens[1:])
            first = np.flatnonzero(opens)
            counts, hashes = np.diff(first, append=len(hashes)), hashes[first]
            del opens, first
            none = pa.nulls(len(hashes), pa.string())
            yield from slices({"lang": none, "phrase": none, "hash": pa.array(hashes.view(np.int64)), "n": pa.array(counts)})

        def listed() -> Batches:
            while seen:
                lang, pairs = seen.popitem()
                hashes = pa.array(np.fromiter(pairs.values(), np.uint64, len(pairs)).view(np.int64))
                phrase = pa.array(pairs, pa.binary()).cast(pa.string())
                del pairs
                none = pa.array(np.zeros(len(phrase), np.int64))
                yield from slices({"lang": pa.repeat(lang, len(phrase)), "phrase": phrase, "hash": hashes, "n": none})

        for lang, words, ids in chunk_rows(batches):
            hashes, ok = survivors(word_hashes(lang, words), ids, known, named + 1)
            if sums and len(ok) > named:
                held.append(hashes[named][ok[named]])
                waiting += len(held[-1])
            if names and len(ok) >= named:
                at = np.flatnonzero(ok[named - 1])
                different, first = np.unique(hashes[named - 1][at], return_index=True)
                # The words of a phrase tell its hash.
                seen.setdefault(lang, {}).update((b" ".join([words[j] for j in ids[i : i + named]]), int(h)) for h, i in zip(different, at[first]))
            if waiting >= HELD:
                yield from summed()
                waiting = 0
            if sum(map(len, seen.values())) >= HELD // 8:
                yield from listed()
        yield from summed()
        yield from listed()

    found = chunks.mapInArrow(released(worker), FOUND).groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
    return found.where(F.col("phrase").isNotNull() | (F.col("n") >= min_count))


def candidates(chunks: DataFrame, words: DataFrame, scratch: Scratch, min_count: int) -> DataFrame:
    """``lang, phrase``: every phrase of 2 to 4 words that occurs ``min_count`` times, and few others."""
    bitmaps, every = [bitmap(hashed_words(words.where("word IS NOT NULL")))], None
    found = from_chunks(find_phrases(chunks, bitmaps, min_count, names=False), scratch, "hashes-2")
    for k in range(2, LONGEST + 1):
        sums = found.where("phrase IS NULL").select("hash")
        bitmaps.append(bitmap(sums))
        found = from_chunks(find_phrases(chunks, bitmaps, min_count, sums=k < LONGEST), scratch, f"hashes-{k + 1}")
        # Bitmaps let a few through by chance; the sums do not.
        named = found.where("phrase IS NOT NULL").join(sums.hint("merge"), "hash", "left_semi").select("lang", "phrase")
        every = named if every is None else every.unionByName(named)
    found = stored(every, scratch, "candidates")
    for shared in bitmaps:  # what was made with them is stored
        shared.destroy()
    return found


def double_array(sequences: list[list[int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and ``accept`` (number of the sequence or -1) of a trie over symbols from 1 on.

    From state s the symbol c leads to t = base[s] + c if check[t] = s.  The root is 0.  Nodes with many children are
    placed first, each at the first base of growing windows where all its children find free cells; the children of nodes with a single one fill the gaps.
    """
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    flat = np.fromiter(chain.from_iterable(sequences), np.int64, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    # Nodes are numbered level by level, so pairs of parent and symbol are in order and parents come before their children.
    node, parents, codes, nodes = np.zeros(len(sequences), np.int64), [], [], 1
    for k in range(lengths.max(initial=0)):
        rows = np.flatnonzero(lengths > k)
        pairs, place = np.unique(node[rows] * (symbols + 1) + flat[starts[rows] + k], return_inverse=True)
        node[rows] = nodes + place
        nodes += len(pairs)
        parents.append(pairs // (symbols + 1))
        codes.append(pairs % (symbols + 1))
    if nodes == 1:
        return np.zeros(1, np.int64), np.full(1, -1, np.int64), np.full(1, -1, np.int64)
    ends = np.full(nodes, -1, np.int64)
    ends[node] = np.arange(len(sequences))
    parent, code, child = np.concatenate(parents), np.concatenate(codes), np.arange(1, nodes)
    opens = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    sizes = np.diff(np.r_[opens, len(parent)])
    base_of = np.zeros(len(ends), np.int64)
    taken = np.zeros(2 * (len(ends) + symbols) + WINDOW, bool)
    taken[0] = True
    cell, size = 1, 0
    several = np.flatnonzero((sizes > 1) | (parent[opens] == 0))
    for k in several[np.lexsort((-sizes[several], parent[opens[several]] != 0))]:
        codes = code[opens[k] : opens[k] + sizes[k]]
        first, codes = int(codes[0]), codes - codes[0]
        # Nodes of one size go on where the last one found room.
        at, width = (cell if sizes[k] == size else 1), WINDOW
        size = sizes[k]
        while True:
            if at + width + int(codes[-1]) >= len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) + width + int(codes[-1]), bool)])
            fits = at + np.flatnonzero(~taken[at : at + width])
            for c in codes[1:]:
                if not len(fits):
                    break
                fits = fits[~taken[fits + c]]
            if len(fits):
                break
            at, width = at + width, 2 * width
        cell = int(fits[0])
        taken[cell + codes] = True
        base_of[parent[opens[k]]] = cell - first
    single = np.setdiff1d(np.arange(len(opens)), several)
    cells = np.flatnonzero(~taken)
    cells = np.concatenate([cells, len(taken) + np.arange(max(0, len(single) - len(cells)))])[: len(single)]
    base_of[parent[opens[single]]] = cells - code[opens[single]]
    state = np.zeros(len(ends), np.int64)
    state[child] = base_of[parent] + code
    size = int(state.max()) + 1
    base, check, accept = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    base[state], accept[state] = base_of, ends
    check[state[child]] = state[parent]
    return base, check, accept


def tries(found: DataFrame, n_phrases: int, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """One double-array trie per shard of the candidates, built where the shard's candidates meet."""
    shards = max(1, -(-n_phrases // shard_phrases))

    def build(table: pa.Table) -> pa.Table:
        shard, table = table["shard"][0].as_py(), table.select(["lang", "phrase"]).combine_chunks()
        langs, phrases = table["lang"].to_pylist(), table["phrase"].to_pylist()
        # Frequent words get low symbols: the children of a node lie close together.
        common = Counter((lang, w) for lang, p in zip(langs, phrases) for w in p.split(" "))
        numbers = {w: k + 1 for k, (w, _) in enumerate(common.most_common())}
        sequences = [[numbers[lang, w] for w in p.split(" ")] for lang, p in zip(langs, phrases)]
        del langs, phrases, common
        arrays = [a.astype(np.int32).tobytes() for a in double_array(sequences, len(numbers))]
        row = [shard, [k[0] for k in numbers], [k[1] for k in numbers], *arrays]
        kinds = [pa.int32(), *[pa.list_(pa.string())] * 2, *[pa.binary()] * 3]
        pairs = pa.StructArray.from_arrays([c.cast(pa.string()).combine_chunks() for c in table.columns], names=["lang", "phrase"])
        keys = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
        names = ["shard", "langs", "words", "base", "check", "accept", "phrases"]
        return pa.table([*[pa.array([v], t) for v, t in zip(row, kinds)], keys], names=names)

    shard = F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("int")
    return found.select(shard.alias("shard"), "lang", "phrase").groupBy("shard").applyInArrow(build, TRIE)


class Trie:
    def __init__(self, langs: list[str], words: list[str], base: bytes, check: bytes, accept: bytes):
        self.symbols: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(langs, words)):
            self.symbols.setdefault(lang, {})[word.encode()] = k + 1
        self.base, self.check, self.accept = (np.frombuffer(a, np.int32) for a in (base, check, accept))

    def accepted(self, lang: str, words: list[bytes], ids: np.ndarray) -> Iterator[np.ndarray]:
        """For each number of words the accepting states of all positions, advanced together."""
        own = np.fromiter(map(self.symbols.get(lang, {}).get, [*words, b""], repeat(0)), np.int64, len(words) + 1)
        symbol = own[ids]  # -1 is the last one, and no symbol
        at, state = np.arange(len(symbol)), np.zeros(len(symbol), np.int64)
        for k in range(LONGEST):
            inside = at + k < len(symbol)
            at, state = at[inside], state[inside]
            code = symbol[at + k]
            to = self.base[state] + code
            good = (code > 0) & (to >= 0) & (to < len(self.check))
            good[good] = self.check[to[good]] == state[good]
            at, state = at[good], to[good]
            yield state[self.accept[state] >= 0]


def count_phrases(chunks: DataFrame, trie: DataFrame, shared: Broadcast) -> DataFrame:
    """``lang, phrase, n``: occurrences of the phrases of one trie, of bounded size, summed over the tasks."""

    def worker(batches: Batches) -> Batches:
        mine = Trie(**shared.value)
        counts = np.zeros(len(mine.check), np.int64)
        for lang, words, ids in chunk_rows(batches):
            for states in mine.accepted(lang, words, ids):
                counts += np.bincount(states, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield from slices({"number": pa.array(mine.accept[at], pa.int64()), "n": pa.array(counts[at])})

    counted = chunks.mapInArrow(released(worker), "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    keys = trie.select(F.posexplode("phrases").alias("number", "key"))
    return counted.join(keys, "number").select("key.lang", "key.phrase", "n")


def phrase_counts(docs: DataFrame, min_count: int = 30, text: str = "text", lang: str = "lang", scratch: Scratch | None = None,
                  shard_phrases: int = SHARD_PHRASES) -> tuple[DataFrame, DataFrame]:
    """Stored tables ``lang, word, n`` (the sum over all words under a null word) and ``k, lang, phrase, n`` of words and
    phrases that occur ``min_count`` times."""
    scratch = scratch or Scratch(docs.sparkSession)
    texts = named(docs, text, lang)
    with rows_of_a_batch(docs.sparkSession, TEXTS_AT_ONCE):
        chunks = stored(encode(texts), scratch, "chunks", CHUNKS_AT_ONCE)
    words = from_chunks(count_words(chunks, min_count), scratch, "words")
    found = candidates(chunks, words, scratch, min_count)
    built = stored(tries(found, found.count(), shard_phrases), scratch, "tries", 1)
    counted = None
    for shard in sorted(r.shard for r in built.select("shard").collect()):
        trie = built.where(F.col("shard") == shard)
        arrays = trie.select("langs", "words", "base", "check", "accept").first().asDict()
        shared = docs.sparkSession.sparkContext.broadcast(arrays)
        part = from_chunks(count_phrases(chunks, trie, shared), scratch, f"counts-{shard}")
        shared.destroy()
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = docs.sparkSession.createDataFrame([], "lang string, phrase string, n long")
    kept = counted.where(F.col("n") >= min_count)
    return words, kept.select(F.size(F.split("phrase", " ")).alias("k"), "lang", "phrase", "n")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang",
                 scratch: Scratch | None = None, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z only) and split at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs into
    words.  ``a`` is the count of a phrase of 2 to 4 words, at least ``min_count``; ``l`` and ``r`` are those of its parts
    before and after a cut and ``score`` is floor(2000000 a / (l + r)) at the cut where that is lowest, the first one of
    equals; ``n`` counts all words of the language.  Phrases inside a longer one with at least ``covered`` per cent of
    their count are left out.  Order: score, a, both from the highest, then the phrase by bytes.  Null languages are
    ``und``; null and empty texts have no words; rows with equal or null ids all count; an empty table has no phrases;
    other columns are not read.
    """
    words, phrases = phrase_counts(docs, min_count, text, lang, scratch, shard_phrases)
    every = phrases.select("lang", "phrase", "n").unionByName(
        words.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "n")
    )
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("total"))
    own = F.split("phrase", " ")
    k = F.size("w")
    cuts = phrases.withColumn("w", own).withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "cut",
        joined(F.slice("w", F.lit(1), F.col("cut"))).alias("head"), joined(F.slice("w", F.col("cut") + 1, k - F.col("cut"))).alias("tail"),
    )
    left = every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) DIV (l + r)")
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("at"))
    inner = phrases.where("k > 2").select("lang", F.col("n").alias("f"), own.alias("w")).withColumn(
        "size", F.explode(F.sequence(F.lit(2), k - 1))
    ).withColumn("from", F.explode(F.sequence(F.lit(1), k - F.col("size") + 1)))
    longer = inner.groupBy("lang", joined(F.slice("w", F.col("from"), F.col("size"))).alias("phrase")).agg(F.max("f").alias("f"))
    free = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("f").isNull() | (F.col("f").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "at.l", "at.r", F.col("total").alias("n"),
        F.col("at.score").cast("long").alias("score"),
    )
