"""SimHash near-deduplication with an inverted index of byte positions."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.components import connected_components
from murmuration.llm.rows import Batches, append_columns, appended, utf8
from murmuration.sources.scratch import Scratch

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BYTES = 8
LIST = 32  # longer lists of the index are linked by way of one-bit neighbours instead of pairs


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it set."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), ">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All rows with ``simhash``, the fingerprint's bits as a long."""
    def worker(batches: Batches) -> Batches:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch, text)], np.uint64)
            yield appended(batch, simhash=pa.array(found.view(np.int64), pa.int64()))

    return append_columns(docs, [T.StructField("simhash", T.LongType())], worker)


def position_sets(max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any two fingerprints within ``max_bits`` agree on all bytes of some set.

    They can differ in ``max_bits`` bytes at most; every choice of so many bytes is left out by one of the sets.
    """
    out, open_pairs = [], set(combinations(range(BYTES), max_bits))
    while open_pairs:
        left = max(combinations(range(BYTES), max_bits + 1),
                   key=lambda c: len(open_pairs & set(combinations(c, max_bits))))
        open_pairs -= set(combinations(left, max_bits))
        out.append(tuple(p for p in range(BYTES) if p not in left))
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _mask(positions: tuple[int, ...]) -> int:
    return sum(255 << 8 * p for p in positions)


def shared_bytes(a: Column, b: Column) -> Column:
    """In how many of the eight positions two fingerprints have the same byte."""
    differing = a.bitwiseXOR(b)
    return sum(
        ((differing.bitwiseAND(F.lit(_signed(255 << 8 * p))) == 0).cast("int") for p in range(BYTES)), F.lit(0)
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS, longest: int = LIST) -> DataFrame:
    """Links ``a, b`` between different ``simhash`` values that connect all pairs within ``max_bits`` bits.

    The index lists fingerprints under the bytes of several sets of positions.  Lists of at most ``longest``
    entries are paired; the positions with equal bytes are tallied, pairs below the guaranteed number (eight less
    ``max_bits``) fall out, the rest is verified bit by bit.  Pairs grow only with the entries, by the constant
    ``longest``.  In a longer list every fingerprint goes to itself and to its one-bit neighbours in the bytes that
    are left free, and those that meet are linked to the smallest there: fingerprints within two bits of each other
    always meet, so no link is lost and the rows stay proportional.  Needs ``max_bits`` of 2 or less for that.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    sets = position_sets(max_bits)
    entries = F.array(*[
        F.struct(F.lit(k).alias("set"), F.col("simhash").bitwiseAND(F.lit(_signed(_mask(s)))).alias("bytes"))
        for k, s in enumerate(sets)
    ])
    index = prints.select("simhash", F.explode(entries).alias("e")).select("simhash", "e.set", "e.bytes")
    sizes = index.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    listed = index.join(sizes, ["set", "bytes"])

    short = listed.where(F.col("n") <= longest)
    left = short.select("set", "bytes", F.col("simhash").alias("a"))
    right = short.select("set", "bytes", F.col("simhash").alias("b"))
    met = left.join(right, ["set", "bytes"]).where(F.col("a") < F.col("b"))
    pairs = met.where(shared_bytes(F.col("a"), F.col("b")) >= BYTES - max_bits).select("a", "b")

    free = [[8 * p + k for p in range(BYTES) if p not in s for k in range(8)] for s in sets]
    flips = F.array(*[F.array(*[F.lit(_signed(1 << bit)) for bit in bits], F.lit(0).cast("long")) for bits in free])
    long_lists = listed.where(F.col("n") > longest).select(
        "set", "simhash", F.explode(F.get(flips, F.col("set"))).alias("flip")
    ).select("set", "simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("near"))
    least = long_lists.groupBy("set", "near").agg(F.min("simhash").alias("b"))
    met_near = long_lists.join(least, ["set", "near"]).select(F.col("simhash").alias("a"), "b").where("a != b")
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.unionByName(met_near).where(verified).distinct()


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS,
                   scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, simhash, component_id`` for every row: the smallest id reachable over near-equal fingerprints.

    Equal fingerprints are merged before anything is compared.  Null and empty texts have fingerprint zero and are
    linked like any other; texts shorter than a shingle are one shingle; repeated rows and equal ids keep their
    rows; null ids are never the smallest, a component of null ids only has a null ``component_id``.  Other columns
    are left out.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    others = scratch.names()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch.store(fingerprints(named).select("doc_id", "simhash"), "fingerprints")
    prints = scratch.store(marked.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = connected_components(links(prints, max_bits), scratch)
    joined = prints.join(roots, prints.simhash == roots.node, "left").select(
        "simhash", "first_id", F.coalesce("root", "simhash").alias("root")
    )
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named_roots = scratch.store(joined.join(smallest, "root").select("simhash", "component_id"), "components")
    scratch.drop(*[n for n in scratch.names() if n not in (*others, "fingerprints", "components")])
    return marked.join(named_roots, "simhash").select("doc_id", "simhash", "component_id")
