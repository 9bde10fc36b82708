"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.rows import Batches, append_columns, appended, strings

SAMPLE_ROWS = 20_000  # labelled documents that are learned from, about
FOLDS = 3
STEPS = 150
PENALTY = 0.002
RATE = 0.1
LEAST_DOCS = 5
CHI_SQUARE = 20.0
WORDS_KNOWN = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The different words of the whole text, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def number(word: str) -> int:
    """64 bits, signed."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


@dataclass
class Rows:
    """Which words the documents have: one flat list of places in ``words``, and whose they are."""

    words: np.ndarray
    flat: np.ndarray
    doc: np.ndarray
    n: int

    @classmethod
    def of(cls, numbers: list[np.ndarray]) -> Rows:
        lengths = [len(x) for x in numbers]
        words, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *numbers]), return_inverse=True)
        return cls(words, flat, np.repeat(np.arange(len(numbers)), lengths), len(numbers))


@dataclass
class Linear:
    """Logistic regression on the words and on the log odds of the categories before."""

    weights: dict[int, float]
    earlier: np.ndarray
    bias: float

    def probability(self, margin: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """``margin`` holds the sum of the documents' word weights."""
        return 1 / (1 + np.exp(-np.clip(margin + earlier @ self.earlier + self.bias, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    clipped = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(clipped / (1 - clipped))


def fit_linear(rows: Rows, chosen: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Linear:
    """Gradient steps with momentum on the log loss, a penalty on the weights, both classes weigh the same.

    Only words that go with the label beyond chance (chi-square on the chosen rows) get a weight.
    """
    size = len(rows.words)
    mask = chosen[rows.doc]
    n, yes = float(chosen.sum()), float(y[chosen].sum())
    seen = np.bincount(rows.flat[mask], minlength=size).astype(float)
    with_label = np.bincount(rows.flat[mask], y[rows.doc[mask]], size)
    spread = seen * (n - seen) * yes * (n - yes)
    telling = (seen >= LEAST_DOCS) & (n * (n * with_label - seen * yes) ** 2 > CHI_SQUARE * spread)
    mask &= telling[rows.flat]
    flat, doc = rows.flat[mask], rows.doc[mask]
    share = np.where(y > 0, 0.5 / max(1.0, yes), 0.5 / max(1.0, n - yes)) * chosen
    w, e, b = np.zeros(size), np.zeros(earlier.shape[1]), 0.0
    mw, me, mb = w.copy(), e.copy(), b
    reach = np.sqrt(np.bincount(flat, share[doc], size)) + 1e-12  # rarer words take smaller steps
    for _ in range(STEPS):
        margin = np.bincount(doc, w[flat], rows.n) + earlier @ e + b
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * share
        mw = 0.9 * mw + np.bincount(flat, slope[doc], size) / reach + PENALTY * w
        me = 0.9 * me + earlier.T @ slope
        mb = 0.9 * mb + slope.sum()
        w, e, b = w - RATE * mw, e - 0.05 * RATE * me, b - RATE * mb
    kept = np.flatnonzero(w)
    return Linear(dict(zip(rows.words[kept].tolist(), w[kept].tolist())), e, float(b))


def fitted_probability(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    weights = np.array([model.weights.get(w, 0.0) for w in rows.words.tolist()])
    return model.probability(np.bincount(rows.doc, weights[rows.flat], rows.n), earlier)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]


class Known(dict):
    """Weights of a word in all models, None for words without any."""

    def __init__(self, chain: Chain):
        self.models = [m.weights for m in chain.models]

    def __missing__(self, word: str) -> np.ndarray | None:
        key = number(word)
        weights = [m.get(key, 0.0) for m in self.models]
        self[word] = found = np.array(weights) if any(weights) else None
        return found


def _number_words(batches: Batches) -> Batches:
    for batch in batches:
        numbers = [[number(w) for w in words_of(t)] for t in strings(batch, "text")]
        yield appended(batch, __words=pa.array(numbers, pa.list_(pa.int64())))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which a document counts: the best F1 among the out-of-fold ones, at least one half."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = 2 * hits / (np.arange(1, len(p) + 1) + max(1.0, float(y.sum())))
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities stand or fall together
    best = int(np.argmax(np.where(last, score, -1)))
    following = p[order][best + 1] if best + 1 < len(p) else 0.0
    return max(0.5, float((p[order][best] + following) / 2))


def sampled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """About ``sample_rows`` labels, chosen by the hash of the id: few enough to broadcast, however many there are."""
    share = min(1.0, sample_rows / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share * (1 << 20))


def fit_chain(labelled: DataFrame, categories: list[str], text: str = "text", sample_rows: int = SAMPLE_ROWS,
              folds: int = FOLDS) -> Chain:
    """Train the categories one after the other on a bounded sample of labelled rows, chosen by the text's hash.

    A model sees the log odds of all earlier categories.  While training these are out of fold: the rows of a fold get
    them from a model that was trained on the other folds, so later models learn from probabilities as uncertain as
    those that they meet in use.  Rows without text or with a null label are not used.  With no rows at all every
    probability is one half and nothing is flagged.
    """
    complete = labelled.where(F.col(text).isNotNull())
    for c in categories:
        complete = complete.where(F.col(c).isNotNull())
    complete = complete.select(F.col(text).alias("text"), *[F.col(c).cast("double").alias(c) for c in categories])
    share = min(1.0, sample_rows / max(1, complete.count()))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    numbered = append_columns(complete.where(place < share), [T.StructField("__words", T.ArrayType(T.LongType()))], _number_words)
    found = numbered.select(F.xxhash64("text").alias("__text"), "__words", *categories).orderBy("__text").toArrow()
    rows = Rows.of([np.array(w.values) for w in found["__words"]])
    fold = found["__text"].to_numpy() % folds
    earlier = np.zeros((rows.n, 0))
    models, thresholds = [], []
    for k in range(len(categories)):
        y = found[categories[k]].to_numpy()
        if not rows.n:
            models.append(Linear({}, np.zeros(k), 0.0))
            thresholds.append(1.0)
            continue
        out_of_fold = np.zeros(rows.n)
        for f in range(folds):
            model = fit_linear(rows, fold != f, y, earlier)
            out_of_fold[fold == f] = fitted_probability(model, rows, earlier)[fold == f]
        models.append(fit_linear(rows, np.ones(rows.n, bool), y, earlier))
        thresholds.append(best_threshold(out_of_fold, y))
        earlier = np.column_stack([earlier, log_odds(out_of_fold)])
    return Chain(categories, models, thresholds)


def score_toxicity(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Every row with ``p_<category>`` for each category and ``is_<category>``, whether it is above the threshold.

    The whole text counts, each different word once.  Null and empty texts have no words and get the probability of
    the bias.  Rows are scored on their own; input columns named like results are replaced.
    """
    def worker(batches: Batches) -> Batches:
        known = Known(chain)
        for batch in batches:
            margins = np.zeros((batch.num_rows, len(chain.models)))
            for row, text_ in enumerate(strings(batch, text)):
                if telling := [w for w in map(known.__getitem__, words_of(text_)) if w is not None]:
                    margins[row] = np.sum(telling, axis=0)
            if len(known) > WORDS_KNOWN:
                known.clear()
            earlier, arrays = np.zeros((batch.num_rows, 0)), {}
            for k, (name, model, limit) in enumerate(zip(chain.categories, chain.models, chain.thresholds)):
                p = model.probability(margins[:, k], earlier)
                arrays |= {f"p_{name}": pa.array(p), f"is_{name}": pa.array(p > limit)}
                earlier = np.column_stack([earlier, log_odds(p)])
            yield appended(batch, **arrays)

    fields = [f for c in chain.categories for f in
              (T.StructField(f"p_{c}", T.DoubleType()), T.StructField(f"is_{c}", T.BooleanType()))]
    return append_columns(docs, fields, worker)
