"""Quality by the perplexity of an interpolated modified Kneser-Ney model over words (``word_ngrams``).

The model over bytes of this module is a separate, smaller one; ``quality`` does not use it.
A gram of ``k`` bytes is a number with the first byte highest.  Counts and probabilities of all orders are tables;
the model is never gathered as a whole unless it fits a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, stored, without
from murmuration.llm.word_ngrams import score_words
from murmuration.sources.scratch import Scratch

ORDER = 5
CHUNK = 4 << 20
SHARD_ROWS = 4_000_000  # of a model, that a task holds at once: 24 bytes each
QUANTILE = 0.98
START = b"\n"


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at every byte of every text, and whose it is; a text begins after line ends."""
    pad = START * (order - 1)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    whose = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(lengths.sum()) + (order - 1) * (whose + 1)
    packed = np.zeros(len(data), np.int64)
    for back in range(order):
        packed[order - 1 :] |= data[order - 1 - back : len(data) - back] << 8 * back
    return packed[at], whose


def _in_chunks(texts: list[bytes]):
    """Slices of the list of about ``CHUNK`` bytes."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            yield slice(start, k + 1)
            start, size = k + 1, 0


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, n`` over the binary column ``bytes``, combined in each task before the shuffle."""
    def worker(batches: Batches) -> Batches:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = [t or b"" for t in batch.column("bytes").to_pylist()]
            for part in _in_chunks(held):
                new, n = np.unique(grams(held[part], order)[0], return_counts=True)
                keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
            if len(keys) >= SHARD_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])

    found = texts.select("bytes").mapInArrow(worker, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """For counts of one, two, three and more; the usual estimates from how many grams have each count."""
    of = [F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*of).first())
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(d, 0.05), k) for d, k in zip(found, (0.95, 1.9, 2.9))]


@dataclass
class Model:
    """``table`` has kind (order, or minus the order for weights of contexts), key and value."""

    order: int
    table: DataFrame
    rows: dict[int, int]  # by the byte before the predicted one; under -1 those that every shard needs


def fit_model(texts: DataFrame, scratch: Scratch, order: int = ORDER) -> Model:
    """Counts of the highest order, continuation counts below, joined by context and by the shorter gram."""
    counts = stored(count_grams(texts, order), scratch, f"counts-{order}")
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram"))
        levels[k] = stored(shorter.agg(F.count("*").alias("n")), scratch, f"counts-{k}")
    lower = None
    parts = []
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[k])
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        keyed = levels[k].select("gram", "n", F.shiftright("gram", 8).alias("context"), cut.alias("cut"))
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("free")).select(
            "context", "total", (F.col("free") / F.col("total")).alias("weight")
        )
        joined = keyed.join(contexts, "context").withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        if lower is None:
            below = F.lit(1.0 / 256)
        else:
            joined = joined.join(lower, "short")
            below = F.col("p_short")
        level = stored(
            joined.select("gram", (((n - F.col("cut")) / F.col("total")) + F.col("weight") * below).alias("p")),
            scratch, f"level-{k}",
        )
        lower = level.select(F.col("gram").alias("short"), F.col("p").alias("p_short"))
        parts += [level.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), F.log("p").alias("value")),
                  contexts.select(F.lit(-k).alias("kind"), F.col("context").alias("key"), F.log("weight").alias("value"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    before = F.when(F.col("kind").isin(1, -1), F.lit(-1)).when(
        F.col("kind") > 0, F.shiftright("key", 8).bitwiseAND(F.lit(255))
    ).otherwise(F.col("key").bitwiseAND(F.lit(255)))
    table = stored(whole.withColumn("byte", before.cast("int")), scratch, "model")
    return Model(order, table, {r["byte"]: r["count"] for r in table.groupBy("byte").count().collect()})


def _shards(model: Model, most: int) -> list[list[int]]:
    """The 256 possible bytes before, in groups whose rows stay below ``most`` where a single byte does."""
    groups, size = [[]], 0
    for byte in range(256):
        n = model.rows.get(byte, 0)
        if groups[-1] and size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(byte)
        size += n
    return groups


class Shard:
    def __init__(self, table: pa.Table, order: int, bytes_: list[int]):
        kind, key, value = (table[c].to_numpy() for c in ("kind", "key", "value"))
        self.order = order
        self.mine = np.zeros(256, bool)
        self.mine[bytes_] = True
        self.tables = {}
        for k in [*range(1, order + 1), *range(-order, 0)]:
            here = np.flatnonzero(kind == k)
            by = here[np.argsort(key[here])]
            self.tables[k] = key[by], value[by].astype(np.float32)

    def _find(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[k]
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def log_likelihood(self, texts: list[bytes]) -> np.ndarray:
        """Sum over the bytes of each text that follow a byte of this shard."""
        whole, whose = grams(texts, self.order)
        take = self.mine[whole >> 8 & 255]
        whole, whose = whole[take], whose[take]
        total = np.zeros(len(whole), np.float32)
        left = np.arange(len(whole))
        for k in range(self.order, 0, -1):
            gram = whole[left] & ((1 << 8 * k) - 1)
            known, value = self._find(k, gram)
            total[left[known]] += value[known]
            left, gram = left[~known], gram[~known]
            known, value = self._find(-k, gram >> 8)
            total[left[known]] += value[known]
        total[left] += np.float32(-np.log(256.0))
        return np.bincount(whose, total, len(texts))


def score_documents(docs: DataFrame, model: Model, text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every row with ``log_likelihood`` and ``perplexity`` for each byte of its whole text; null for empty texts.

    The documents meet one shard of the model after the other, in the same tasks; shards are cut by the byte before
    the predicted one and hold about ``shard_rows`` rows, so what is broadcast does not grow with the corpus.
    """
    common = model.table.where("byte = -1")
    out = without(docs, ["log_likelihood", "perplexity"])
    fields = [T.StructField("log_likelihood", T.DoubleType())]
    for bytes_ in _shards(model, shard_rows):
        part = model.table.where(F.col("byte").isin(bytes_)).unionByName(common).drop("byte")
        shared = docs.sparkSession.sparkContext.broadcast(part.toArrow())

        def worker(batches: Batches, shared=shared, bytes_=bytes_) -> Batches:
            shard = Shard(shared.value, model_order, bytes_)
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
                sums = [np.zeros(0)] + [shard.log_likelihood(texts[s]) for s in _in_chunks(texts)]
                found = np.concatenate(sums)
                if "log_likelihood" in batch.schema.names:
                    found = found + batch.column("log_likelihood").to_numpy(zero_copy_only=False)
                    batch = batch.drop_columns(["log_likelihood"])
                yield appended(batch, log_likelihood=pa.array(found, pa.float64()))

        model_order = model.order
        out = append_columns(out, fields, worker) if "log_likelihood" not in out.columns else out.mapInArrow(worker, out.schema)
    size = F.octet_length(F.col(text))
    return out.withColumn("perplexity", F.when(size > 0, F.exp(-F.col("log_likelihood") / size)))


def exact_quantile(scored: DataFrame, quantile: float) -> DataFrame:
    """``lang, threshold``: the smallest perplexity that at least ``quantile`` of a language's rows do not exceed.

    Rough quantiles bracket it; ranks are counted only inside, over different values, from the rows below on.
    """
    accuracy = 10_000
    step = 2.0 / accuracy
    rough = F.percentile_approx("perplexity", [max(0.0, quantile - step), min(1.0, quantile + step)], accuracy)
    known = scored.where(F.col("perplexity").isNotNull())
    ends = known.groupBy("lang").agg(rough.alias("ends"), F.ceil(F.count("*") * quantile).alias("rank")).select(
        F.col("lang").alias("of"), "rank", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")
    )
    met = known.join(F.broadcast(ends), known["lang"].eqNullSafe(ends["of"])).where("perplexity <= high")
    value = F.when(F.col("perplexity") >= F.col("low"), F.col("perplexity"))  # null: below the bracket
    tallied = met.groupBy("lang", "rank", value.alias("value")).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("value").asc_nulls_first()))
    return tallied.withColumn("up_to", up_to).where("value IS NOT NULL AND up_to >= rank").groupBy("lang").agg(
        F.min("value").alias("threshold")
    )


def quality(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
            quantile: float = QUANTILE, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, language, ``perplexity``, ``threshold`` and ``kept`` for every row.

    ``trusted`` has the ids of trusted documents.  Their whole text is counted; every document, trusted or not, is
    scored with the counts without its own fold (by the hash of the id), because a model flatters what it has seen.
    In each language the ``quantile`` of the perplexities of all trusted documents is the threshold.  Documents at or
    below it are kept.  Null languages are a language of their own.  Empty and null texts have no perplexity and are
    not kept; where a language has no trusted document with text there is no threshold and documents with text are
    kept.  Ids that occur in several trusted rows count once; null ids are never trusted.  Other columns are left out.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    others = scratch.names()
    ids = trusted.select(F.col(doc_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # One plan at every size: the list of trusted ids grows with the corpus and is not broadcast where it happens to fit.
    scored = stored(score_words(named, ids, scratch), scratch, "scored")
    scratch.drop(*[n for n in scratch.names() if n not in (*others, "scored")])
    limits = exact_quantile(scored.join(ids, "doc_id", "left_semi"), quantile)
    limits = limits.withColumnRenamed("lang", "of")
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["of"]), "left")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
