"""Removal of long repeated byte strings with suffix sorting by bucket pointers.

Every string of ``WIDTH`` bytes belongs to one *anchor*: of its short grams the one with the smallest hash, the
leftmost if there are several.  Equal strings have equal anchors, so all occurrences of a string meet under the hash
of its anchor, wherever they are.  Neighbouring strings with the same anchor make up one *run*; only runs travel, one
row for about a hundred bytes of text, and only those whose anchor occurs again are ever looked at closer:

* runs of equal content repeat as a whole; they are found by their fingerprints and never compared;
* different runs under one anchor are cut out of their texts once each and suffix-sorted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from murmuration.llm.rows import Batches, stored
from murmuration.sources.scratch import Scratch

WIDTH = 200
GRAM = 32
CHUNK = 1 << 20  # bytes handled at once in a task
MANY = 4096  # different runs under one anchor beyond which single strings are counted instead of sorted


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from every position on."""
    factor = 0x9E3779B97F4A7C15
    hashes = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    step = 1
    while step < gram:
        hashes = hashes[: len(hashes) - step] * np.uint64(factor) + hashes[step:]
        factor = factor * factor % 2**64
        step *= 2
    for shift, times in ((32, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        hashes ^= hashes >> np.uint64(shift)
        hashes *= np.uint64(times)
    return hashes ^ (hashes >> np.uint64(32))


def leftmost_minima(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest value among ``span`` neighbours from every position on, the leftmost of equal ones.

    The order is that of the upper bits; the lower ones hold the position.
    """
    bits = np.uint64(max(20, len(values).bit_length()))
    least = values >> bits << bits | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = span - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs(data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First string, number of strings and anchor's hash of all runs; ``bounds`` are where texts begin, and the end."""
    lengths = np.diff(bounds)
    room = np.maximum(lengths - width + 1, 0)
    if not room.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    hashes = gram_hashes(data, gram)
    anchor = leftmost_minima(hashes, width - gram + 1)
    begin = np.repeat(bounds[:-1] - np.cumsum(np.append(0, room[:-1])), room) + np.arange(room.sum())
    anchor = anchor[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(begin)))
    return begin[first], count, hashes[anchor[first]].view(np.int64)


def repeated_strings(data: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Which of the strings that start at ``begin`` start there more than once; suffix sorting to ``width`` bytes.

    Suffixes are put into buckets by their first four bytes.  Then buckets are refined by sorting their members on
    the bucket of the suffix that begins where the known prefix ends; the refined buckets serve as pointers of the
    next round, so that the sorted length doubles.  Suffixes alone in their bucket are sorted for good, and so is
    every suffix that points to one.  ``width`` is more than four.
    """
    padded = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint32)
    grams = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    bucket = np.unique(grams, return_inverse=True)[1].astype(np.int64)
    shared = np.bincount(bucket)[bucket] > 1
    known = 4
    while known < width:
        ahead = min(known, width - known)
        active = np.flatnonzero(shared[: len(bucket) - ahead] & shared[ahead:])
        if known + ahead == width:
            active = active[np.isin(active, begin, assume_unique=True)]
        pair = bucket[active] * (int(bucket.max()) + 1) + bucket[active + ahead]
        number, counts = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        bucket, shared = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), bool)
        bucket[active] = number
        shared[active] = counts[number] > 1
        bucket[bucket < 0] = 0
        known += ahead
    return shared[begin]


def _stretches(begin: np.ndarray) -> list[tuple[int, int]]:
    """First and last of neighbouring positions."""
    if not len(begin):
        return []
    cut = np.flatnonzero(np.diff(begin) > 1)
    return list(zip(begin[np.append(0, cut + 1)].tolist(), begin[np.append(cut, len(begin) - 1)].tolist()))


def _chunks(texts: Iterator[bytes], most: int) -> Iterator[list]:
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(batches: Batches, text: str) -> Iterator[tuple]:
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != text]
        yield from zip(*others, batch.column(text).to_pylist())


def _list_runs(width: int, gram: int, names: list[str]):
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            long_enough = ((i, t) for i, t in enumerate(batch.column("bytes").to_pylist()) if len(t) >= width)
            for held in _chunks(long_enough, CHUNK):
                whole = b"".join(t for _, t in held)
                bounds = np.cumsum([0, *[len(t) for _, t in held]])
                begin, count, key = runs(np.frombuffer(whole, np.uint8), bounds, width, gram)
                owner = np.searchsorted(bounds, begin, "right") - 1
                taken = pa.array(np.array([i for i, _ in held])[owner])
                content = [xxhash.xxh3_64_intdigest(whole[b : b + c + width - 1])
                           for b, c in zip(begin.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(taken), batch.column("digest").take(taken), pa.array(key),
                     pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(begin - bounds[owner]),
                     pa.array(count.astype(np.int32))],
                    names=names,
                )

    return worker


def _cut_out(width: int, names: list[str]):
    """The bytes of the runs listed with each text."""
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                text = part.column("bytes")[0].as_py()
                listed = part.column("runs")[0].values
                start, count = listed.field("start").to_pylist(), listed.field("count").to_pylist()
                same = pa.array(np.zeros(len(start), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(same), part.column("digest").take(same), listed.field("key"),
                     listed.field("start"), listed.field("count"), listed.field("copies"),
                     pa.array([text[s : s + c + width - 1] for s, c in zip(start, count)], pa.binary())],
                    names=names,
                )

    return worker


def _pieces(held: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where strings begin, and which piece they belong to."""
    data = np.frombuffer(b"".join(r[-1] for r in held), np.uint8)
    bounds = np.cumsum([0, *[len(r[-1]) for r in held]])
    room = np.diff(bounds) - width + 1
    piece = np.repeat(np.arange(len(held)), room)
    begin = np.arange(room.sum()) - np.repeat(np.cumsum(np.append(0, room[:-1])), room) + bounds[piece]
    return data, begin, piece


def _sort_buckets(width: int, schema: pa.Schema):
    """Repeated strings of runs that come ordered by anchor; runs of one anchor stay together."""
    def worker(batches: Batches) -> Batches:
        held, size, last = [], 0, None
        for row in _rows(batches, "piece"):
            if size >= CHUNK and row[2] != last:
                yield from emit(held)
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
            last = row[2]
        if held:
            yield from emit(held)

    def emit(held: list[tuple]) -> Batches:
        data, begin, piece = _pieces(held, width)
        again = repeated_strings(data, begin, width)
        low = np.searchsorted(piece, np.arange(len(held) + 1))
        bounds = np.cumsum([0, *[len(r[-1]) for r in held]]).tolist()
        out = []
        for k in np.unique(piece[again]).tolist():
            doc_id, digest, _, start, _, copies, _ = held[k]
            if copies == 1:  # others repeat as a whole
                here = slice(low[k], low[k + 1])
                for a, b in _stretches(begin[here][again[here]] - bounds[k]):
                    out.append((doc_id, digest, start + a, start + b + width))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)

    return worker


def _list_strings(width: int, schema: pa.Schema):
    """Digests of all strings of a run, for anchors with very many different runs."""
    def worker(batches: Batches) -> Batches:
        for doc_id, digest, _, start, count, copies, piece in _rows(batches, "piece"):
            hashes = [xxhash.xxh3_128_digest(piece[k : k + width]) for k in range(count)]
            columns = [[doc_id] * count, [digest] * count, hashes, range(start, start + count), [copies] * count]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)],
                                             names=schema.names)

    return worker


def _remove(batches: Batches) -> Batches:
    for batch in batches:
        spans, kept, removed = [], [], []
        for text, found in zip(batch.column("bytes").to_pylist(), batch.column("found").to_pylist()):
            merged: list[list[int]] = []
            for low, high in sorted((s["begin"], s["end"]) for s in found or ()):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            ends = [0, *[high for _, high in merged]]
            starts = [*[low for low, _ in merged], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, starts)))
            removed.append(sum(high - low for low, high in merged))
            spans.append([{"begin": low, "end": high} for low, high in merged])
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in batch.column("bytes").to_pylist()], pa.int64()),
             pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id",
                   many: int = MANY, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row.

    ``spans`` (begin, end) are the maximal runs of bytes covered by strings of ``width`` bytes that also start
    anywhere else in the table, the same text included; ``kept`` holds the other bytes.  Strings are judged on the
    input.  Bytes are those of UTF-8, a cut may fall inside of a character, so ``kept`` is binary.

    Null and empty texts have no bytes; texts shorter than ``width`` lose nothing; repeated rows lose everything that
    is long enough; null or equal ids do no harm, because a text is known by its id and a hash of its content.  Other
    columns are left out.  Where more than ``many`` different runs have one anchor their strings are counted one by
    one, so no task gathers them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    long, whole = T.LongType(), T.IntegerType()
    owner = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("digest", long)]
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("digest"),
                        content.cast("binary").alias("bytes"))

    listed = T.StructType([*owner, T.StructField("key", long), T.StructField("content", long),
                           T.StructField("start", long), T.StructField("count", whole)])
    all_runs = stored(texts.mapInArrow(_list_runs(width, gram, listed.fieldNames()), listed), scratch, "runs")
    anchors = all_runs.groupBy("key").agg(
        F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
    ).where("n > 1").select("key", (F.col("low") != F.col("high")).alias("differ"))
    anchors = stored(anchors, scratch, "anchors")  # so that the join has two exchanges and Spark splits a hot anchor
    again = stored(all_runs.join(anchors, "key"), scratch, "repeated")
    scratch.drop("runs", "anchors")
    differing = again.where("differ")
    kinds = stored(
        differing.groupBy("key", "content").agg(
            F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "digest", "start", "count")]
        ),
        scratch, "kinds",
    )
    span = ["doc_id", "digest", F.col("start").alias("begin"),
            (F.col("start") + F.col("count") + F.lit(width - 1)).alias("end")]
    copied = kinds.where("copies > 1").select("key", "content")
    spans = again.where(~F.col("differ")).select(*span).unionByName(
        differing.join(copied.hint("merge"), ["key", "content"]).select(*span)  # Spark splits it where a run is hot
    )

    crowds = stored(kinds.groupBy("key").count().where(F.col("count") > many).select("key"), scratch, "crowds")
    spans = spans.unionByName(_sorted_spans(texts, kinds.join(crowds, "key", "left_anti"), owner, width))
    if not crowds.isEmpty():
        spans = spans.unionByName(_counted_spans(texts, kinds.join(crowds, "key"), owner, width))
    found = spans.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("begin", "end")).alias("found"))
    result = T.StructType([
        owner[0], T.StructField("n_bytes", long), T.StructField("n_removed", long),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", long), T.StructField("end", long)]))),
        T.StructField("kept", T.BinaryType()),
    ])
    joined = texts.join(found, _same_text(texts, found), "left").select(texts["doc_id"], "bytes", "found")
    return joined.mapInArrow(_remove, result)


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])


def _cut(texts: DataFrame, kinds: DataFrame, owner: list[T.StructField], width: int) -> DataFrame:
    """One row with the bytes of each of the runs."""
    by_text = kinds.groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("key", "start", "count", "copies")).alias("runs")
    )
    joined = texts.join(by_text, _same_text(texts, by_text)).select(texts["doc_id"], texts["digest"], "bytes", "runs")
    schema = T.StructType([
        *owner, T.StructField("key", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("count", T.IntegerType()), T.StructField("copies", T.LongType()),
        T.StructField("piece", T.BinaryType()),
    ])
    return joined.mapInArrow(_cut_out(width, schema.fieldNames()), schema)


def _sorted_spans(texts: DataFrame, kinds: DataFrame, owner: list[T.StructField], width: int) -> DataFrame:
    pieces = _cut(texts, kinds, owner, width)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*owner, T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return pieces.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        _sort_buckets(width, to_arrow_schema(schema)), schema
    )


def _counted_spans(texts: DataFrame, kinds: DataFrame, owner: list[T.StructField], width: int) -> DataFrame:
    schema = T.StructType([*owner, T.StructField("string", T.BinaryType()), T.StructField("start", T.LongType()),
                           T.StructField("copies", T.LongType())])
    strings = _cut(texts, kinds, owner, width).mapInArrow(_list_strings(width, to_arrow_schema(schema)), schema)
    again = strings.groupBy("string").count().where("count > 1").select("string")
    return strings.join(again, "string").where("copies = 1").select(
        "doc_id", "digest", F.col("start").alias("begin"), (F.col("start") + F.lit(width)).alias("end")
    )
