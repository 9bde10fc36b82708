"""Lines that many documents share are dropped; a sharded minimal perfect hash knows the lines.

The hashes of the different lines that occur in enough documents are dealt to shards.  A shard is a minimal perfect hash
(levels of bits, each holding the keys that are alone at their place, and ranks to number them) over an array of
fingerprints and one of document counts.  Documents look their lines up in these arrays; no line is joined and no text is
shuffled.  A line is known by 128 bits of its hash, 64 of which are the fingerprint.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, stored, utf8, without
from murmuration.sources.scratch import Scratch

SHARD_KEYS = 1 << 16
INDEX_BYTES = 256 << 20  # of arrays that are broadcast
HELD = 1 << 20  # line hashes that a task combines at once
NEWLINE = b"\n"
_STEP, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
INDEX = "shard int, n int, sizes binary, bits binary, fingerprints binary, counts binary"


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in text.lower().split(NEWLINE)]


def _digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def count_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``hi, lo, n``: the hash of each line that is not blank and the number of rows that have it, combined in the tasks."""
    def worker(batches: Batches) -> Batches:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
            counts = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(counts)], names=["hi", "lo", "n"])

        for batch in batches:
            for t in utf8(batch, text):
                if t:
                    held.update(map(xxhash.xxh3_128_digest, set(line_keys(t)) - {b""}))
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(worker, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _places(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves for a level; different keys differ in almost every level."""
    with np.errstate(over="ignore"):
        x = hi + lo * (_STEP * np.uint64(2 * level + 1)) + _LEVEL
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_shard(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Sizes of the levels in words, their bits, and fingerprints and counts in the order of the perfect hash."""
    left, sizes, words, slots = np.arange(len(hi)), [], [], np.zeros(len(hi), np.int64)
    base = 0
    while len(left):
        size = -(-2 * len(left) // 64)
        place = (_places(hi[left], lo[left], len(sizes)) % np.uint64(64 * size)).astype(np.int64)
        alone = np.bincount(place, minlength=64 * size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        placed = alone[place]
        slots[left[placed]] = base + (np.cumsum(alone) - 1)[place[placed]]
        base += int(placed.sum())
        left = left[~placed]
        sizes.append(size)
    prints, numbers = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32)
    prints[slots] = lo
    numbers[slots] = np.minimum(counts, 0xFFFFFFFF)
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return np.array(sizes, np.int64).tobytes(), bits.tobytes(), prints.tobytes(), numbers.tobytes()


def line_index(lines: DataFrame, n_lines: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard of the ``hi, lo, n`` of different lines, built where the shard's lines meet, ``shard_keys`` or so."""
    shards = max(1, -(-n_lines // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        hi, lo = (table[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        made = build_shard(hi, lo, table["n"].to_numpy())
        row = [table["shard"][0].as_py(), len(hi), *made]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["shard", "n", "sizes", "bits", "fingerprints", "counts"]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    dealt = lines.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "hi", "lo", "n")
    return dealt.groupBy("shard").applyInArrow(build, INDEX)


class LineIndex:
    """All shards side by side: arrays of their bits, ranks, fingerprints and counts, and where each shard begins."""

    def __init__(self, table: pa.Table, shards: int):
        self.shards = shards
        rows = {r["shard"]: r for r in table.to_pylist()}
        sizes = [np.frombuffer(rows[s]["sizes"], np.int64) if s in rows else np.zeros(0, np.int64) for s in range(shards)]
        self.levels = max([len(s) for s in sizes], default=0)
        self.size = np.zeros((self.levels, shards), np.int64)
        for s, held in enumerate(sizes):
            self.size[: len(held), s] = held
        ends = np.cumsum(self.size.T.ravel()).reshape(shards, self.levels).T
        self.start = ends - self.size

        def joined(name, kind):
            return np.frombuffer(b"".join(rows[s][name] for s in sorted(rows)), kind)

        self.bits = joined("bits", np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.prints, self.counts = joined("fingerprints", np.uint64), joined("counts", np.uint32)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The documents of each line; zero for lines that the index does not have."""
        found = np.zeros(len(hi), np.int64)
        shard = np.mod(hi.view(np.int64), self.shards)
        left = np.arange(len(hi))
        for level in range(self.levels):
            left = left[self.size[level, shard[left]] > 0]
            at, size = shard[left], self.size[level, shard[left]].astype(np.uint64)
            place = (_places(hi[left], lo[left], level) % (np.uint64(64) * size)).astype(np.int64)
            word, bit = self.start[level, at] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
            here = (self.bits[word] & bit) != 0
            slot = self.rank[word[here]] + np.bitwise_count(self.bits[word[here]] & (bit[here] - np.uint64(1)))
            same = self.prints[slot] == lo[left[here]]
            found[left[here][same]] = self.counts[slot[same]]
            left = left[~here]
        return found


def _drop(batch: pa.RecordBatch, text: str, repeated) -> pa.RecordBatch:
    """Append the columns of the result; ``repeated`` tells of all lines of the batch, by their keys, which go."""
    texts = [t or b"" for t in utf8(batch, text)]
    keys = [line_keys(t) for t in texts]
    n_lines = np.array([len(k) for k in keys], np.int64)
    flat = [k for held in keys for k in held]
    gone = repeated(flat, n_lines) & np.fromiter(map(bool, flat), bool, len(flat))
    ends = np.cumsum(n_lines)
    n_dropped = np.add.reduceat(gone, ends - n_lines, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    for k in np.flatnonzero(n_dropped):
        stay = ~gone[ends[k] - n_lines[k] : ends[k]]
        texts[k] = NEWLINE.join([line for line, s in zip(texts[k].split(NEWLINE), stay) if s])
    kept = pa.array(texts, pa.binary()).cast(pa.string())
    return appended(batch, n_lines=pa.array(n_lines), n_dropped=pa.array(n_dropped), kept=kept)


FIELDS = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]


def probe_documents(docs: DataFrame, index: DataFrame, shards: int, min_docs: int, text: str = "text") -> DataFrame:
    """Every row with the lines left that the index does not know, or from fewer than ``min_docs`` documents.

    The arrays go to all tasks: call this for an index of a known size only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index.toArrow())

    def worker(batches: Batches) -> Batches:
        known = LineIndex(shared.value, shards)

        def repeated(keys: list[bytes], _) -> np.ndarray:
            return known.count(*_digests(keys)) >= min_docs

        for batch in batches:
            yield _drop(batch, text, repeated)

    return append_columns(docs, FIELDS, worker)


def join_documents(docs: DataFrame, lines: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """The same by joins, for more lines than can be broadcast: hashes of lines travel below the hash of their text."""
    def pairs(batches: Batches) -> Batches:
        for batch in batches:
            texts = {xxhash.xxh3_128_digest(t): t for t in utf8(batch, text) if t}
            keys = [set(line_keys(t)) - {b""} for t in texts.values()]
            of = np.repeat(np.frombuffer(b"".join(texts), np.int64).reshape(-1, 2), [len(k) for k in keys], axis=0)
            hi, lo = _digests([k for held in keys for k in held])
            columns = [of[:, 0], of[:, 1], hi.view(np.int64), lo.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["thi", "tlo", "hi", "lo"])

    def named(batches: Batches) -> Batches:
        for batch in batches:
            hi, lo = _digests([t or b"" for t in utf8(batch, text)])
            yield appended(batch, __thi=pa.array(hi.view(np.int64)), __tlo=pa.array(lo.view(np.int64)))

    def worker(batches: Batches) -> Batches:
        for batch in batches:
            sets = [{struct.pack("<qq", d["hi"], d["lo"]) for d in s or []} for s in batch.column("__gone").to_pylist()]

            def repeated(keys: list[bytes], n_lines: np.ndarray) -> np.ndarray:
                of = np.repeat(np.arange(len(sets)), n_lines)
                return np.fromiter((xxhash.xxh3_128_digest(k) in sets[i] for k, i in zip(keys, of)), bool, len(keys))

            plain = _drop(batch, text, repeated)
            yield plain.drop_columns(["__gone"])

    asked = docs.select(text).mapInArrow(pairs, "thi long, tlo long, hi long, lo long").distinct()
    met = asked.join(lines.select("hi", "lo").hint("merge"), ["hi", "lo"])
    found = met.groupBy(F.col("thi").alias("__thi"), F.col("tlo").alias("__tlo"))
    gone = stored(found.agg(F.collect_list(F.struct("hi", "lo")).alias("__gone")), scratch, "dropped")
    keyed = append_columns(docs, [T.StructField("__thi", T.LongType()), T.StructField("__tlo", T.LongType())], named)
    rows = keyed.join(gone.hint("merge"), ["__thi", "__tlo"], "left").drop("__thi", "__tlo")
    kept = without(rows, [f.name for f in FIELDS])
    return kept.mapInArrow(worker, T.StructType([*[f for f in kept.schema.fields if f.name != "__gone"], *FIELDS]))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", index_bytes: int = INDEX_BYTES,
                        shard_keys: int = SHARD_KEYS, scratch: Scratch | None = None) -> DataFrame:
    """Every row with ``n_lines`` (before), ``n_dropped`` and ``kept``, the text without its repeated lines.

    A line is repeated if its key (see ``line_keys``) has a code point and is found in at least ``min_docs`` rows; then
    all lines of that key go.  Lines end at line feeds; null and empty texts are one empty line, and ``kept`` is empty.
    Every row counts, also rows with equal or null ids.  Texts of any length are read as a whole.  An empty table
    gives an empty table.  Columns of the input that are named like results are replaced.

    Lines and index are stored in the shared folder.  While the index takes at most ``index_bytes`` the tasks have it;
    a larger one is not broadcast: the hashes of lines are joined, with the same result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    lines = stored(count_lines(docs, text).where(F.col("n") >= min_docs), scratch, "lines")
    n_lines = lines.count()
    # 2 x 64 + 32 bits a line, levels of bits (4 a line at most) and their ranks
    if 17 * n_lines > index_bytes:
        return join_documents(docs, lines, scratch, text)
    shards = max(1, -(-n_lines // shard_keys))
    index = stored(line_index(lines, n_lines, shard_keys), scratch, "index")
    return probe_documents(docs, index, shards, min_docs, text)
