"""Language identification by compression with one dictionary for each language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, strings

UNKNOWN = "und"
OUTPUT = ["lang_pred", "score", "rejected"]
SAMPLE_DOCS = 400  # bounds of what is learned from, for each language
SAMPLE_CHARS = 1000
DICTIONARY_BYTES = 128 << 10
MAX_LANGUAGES = 500
PIECE = 16 << 10
LEVEL = 5  # with matches of four bytes on: lower levels miss short stems
MIN_MATCH = 4
MIN_MARGIN = 0.004
CONTEXT = 3  # bytes before the one whose code length is measured
PRIOR = 4.0  # how many sightings the shorter context counts for

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, one space between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """True for rows to learn from; the others are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 4 != 2


def learn_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS,
                       sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample: about ``sample_docs`` different texts of each language, chosen by
    the hash of the text, ``sample_chars`` characters of each from a place that the hash gives, so that openings weigh
    no more than bodies.  Of the joined pieces ``dictionary_bytes`` are kept.  Rows without text or language are not
    used; copies count once, and only different pieces reach the driver."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    tallies = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("text").alias("different"))
    found_languages = tallies.limit(MAX_LANGUAGES + 1).collect()
    counts = {r["lang"]: r["count"] for r in found_languages}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in found_languages for x in (r["lang"], min(1.0, sample_docs / max(1, r["different"])))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.char_length("text") - sample_chars + 1, F.lit(1)).cast("long"))
    piece = F.col("text").substr(start.cast("int") + 1, F.lit(sample_chars))
    sample = rows.where(place < share[F.col("lang")]).select("lang", piece.alias("text")).distinct()
    texts: dict[str, set[str]] = {}
    for row in sample.collect():
        texts.setdefault(row["lang"], set()).add(letters(row["text"]))
    out = {}
    for name, found in texts.items():
        joined = " ".join(sorted(found, key=lambda t: xxhash.xxh64_intdigest(t.encode()))).encode()[:dictionary_bytes]
        if len(joined) >= 8:
            out[name] = joined
    return dict(sorted(out.items(), key=lambda item: (-counts[item[0]], item[0])))


class Lengths:
    """Code lengths in fractions of a bit under the byte sequences of one dictionary.

    A sorted array has the four bytes from each place of the dictionary on; how often shorter sequences occur are
    ranges of it.
    """

    def __init__(self, content: bytes):
        self.places = np.sort(self._packed(b" " + content + b" " * (CONTEXT + 1)))

    @staticmethod
    def _packed(data: bytes) -> np.ndarray:
        """The sequences of ``CONTEXT + 1`` bytes as numbers, first byte highest."""
        one, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data) - CONTEXT
        return sum(one[k : k + n] << 8 * (CONTEXT - k) for k in range(CONTEXT + 1))

    def _count(self, sequence: np.ndarray, size: int) -> np.ndarray:
        low = sequence << 8 * (CONTEXT + 1 - size)
        high = (sequence + 1) << 8 * (CONTEXT + 1 - size)
        return (np.searchsorted(self.places, high) - np.searchsorted(self.places, low)).astype(float)

    def bits(self, data: bytes) -> float:
        """Of the words and the spaces around them; contexts of all sizes are interpolated."""
        whole = self._packed(b" " * CONTEXT + data + b" ")
        p = np.full(len(whole), 1.0 / 256)
        for size in range(1, CONTEXT + 2):
            sequence = whole & ((1 << 8 * size) - 1)
            before = self._count(sequence >> 8, size - 1) if size > 1 else float(len(self.places))
            p = (self._count(sequence, size) + PRIOR * p) / (before + PRIOR)
        return float(-np.log2(p).sum())


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.contents = list(dictionaries.values())
        self.lengths: dict[int, Lengths] = {}
        self.compress = []
        for content in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE, dict_size=len(content), min_match=MIN_MATCH,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            shared.precompute_compress(compression_params=settings)
            compressor = zstandard.ZstdCompressor(dict_data=shared, compression_params=settings)
            self.compress.append(compressor.compress)

    def best(self, text: str | None) -> tuple[str, float]:
        """The language whose dictionary leaves the fewest bytes, and by which share the next one is longer.

        Sizes are whole bytes, and below about 25 bytes the frames hold the text as it is.  Where sizes tie and one
        byte would be a clear margin, the tie is rounding: the code lengths of those languages decide in fractions of
        a bit.  Of equal lengths the language wins that comes first, the most frequent one of those that were learned.
        """
        data = letters(text).encode()
        if not data or not self.names:
            return UNKNOWN, 0.0
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(c(p)) for p in pieces), k) for k, c in enumerate(self.compress))
        if len(sizes) == 1:
            return self.names[0], 1.0
        least = sizes[0][0]
        if least == sizes[1][0] and MIN_MARGIN * least < 1:
            sizes = sorted((self._length(k).bits(data), k) for size, k in sizes if size == least)
        return self.names[sizes[0][1]], 1.0 - sizes[0][0] / sizes[1][0]

    def _length(self, k: int) -> Lengths:
        if k not in self.lengths:
            self.lengths[k] = Lengths(self.contents[k])
        return self.lengths[k]


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
                      min_margin: float = MIN_MARGIN) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``rejected``.

    The whole text (letters only, lower-cased) is compressed with each language's dictionary, in pieces so that the
    dictionary counts throughout; the smallest total wins.  Ties of short texts, which come from whole bytes, are decided
    by code lengths under the same dictionaries, other ties go to the language with most training rows.  ``score`` is the
    margin, one less the ratio of the smallest to the next size or length.  Rows with a margin below ``min_margin`` are
    ``rejected``.  Null texts and texts without a letter, and all texts where nothing could be learned, are ``und``
    with score 0 and rejected.  Input columns named like results are replaced.
    """
    def worker(batches: Batches) -> Batches:
        compressors = Compressors(dictionaries)
        for batch in batches:
            found = [compressors.best(t) for t in strings(batch, text)]
            yield appended(
                batch,
                lang_pred=pa.array([f[0] for f in found], pa.string()),
                score=pa.array([f[1] for f in found], pa.float64()),
                rejected=pa.array([f[0] == UNKNOWN or f[1] < min_margin for f in found], pa.bool_()),
            )

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, fields, worker)
