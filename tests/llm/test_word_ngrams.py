"""Word trigrams against nested dictionaries."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from murmuration.llm import kneser_ney, word_ngrams
from murmuration.sources.scratch import Scratch

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat sat on the log", "the end", "the dog sat", "été à la mer"]


def plain_log_p(texts):
    levels = {3: Counter()}
    for t in texts:
        w = ["", "", *word_ngrams.WORD.findall(t), None]
        levels[3].update(zip(w, w[1:], w[2:]))
    for k in (2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, contexts = {}, {}
    for k, counts in levels.items():
        n = [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        cuts[k] = [0.5] * 3
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0]
            cuts[k] = [min(max(a, 0.05), b) for a, b in zip(d, (0.95, 1.9, 2.9))]
        for g, c in counts.items():
            total, free = contexts.get((k, g[:-1]), (0, 0.0))
            contexts[k, g[:-1]] = total + c, free + cuts[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if k:
            below = p(gram[1:]) if k > 1 else 257.0 ** -(1 if gram[0] is None else len(gram[0].encode()) + 1)
        if (k, gram[:-1]) not in contexts:
            return below
        total, free = contexts[k, gram[:-1]]
        c = levels[k].get(gram, 0)
        return (c - cuts[k][min(c, 3) - 1] if c else 0) / total + free / total * below

    return p


def test_perplexity_against_nested_dictionaries(spark):
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate([*TEXTS * 3, "a zebra sat", "", " \n", None])],
                                 "doc_id long, lang string, text string")
    ids = docs.where("doc_id < 18").select("doc_id")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(word_ngrams.FOLDS)).alias("f")).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = word_ngrams.score_words(docs, ids, Scratch(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        if not rows[r.doc_id]:
            assert r.perplexity is None
            continue
        p = plain_log_p([rows[k] for k in range(18) if fold[k] != fold[r.doc_id]])
        w = ["", "", *word_ngrams.WORD.findall(rows[r.doc_id]), None]
        wanted = -sum(math.log(p(g)) for g in zip(w, w[1:], w[2:])) / len(rows[r.doc_id].encode())
        assert abs(math.log(r.perplexity) - wanted) < 1e-6, r


def test_order_of_words_counts_and_the_table_grows(spark):
    draw = random.Random(1)
    names = [f"{a}{b}{c}" for a in ("bar", "tel", "mon", "sur") for b in "aeiou" for c in ("ne", "ta", "li", "ro")]
    after = {n: draw.sample(names, 3) for n in names}

    def text():
        out = [draw.choice(names)]
        while len(out) < 60:
            out.append(draw.choice(after[out[-1]]))
        return out

    clean = [text() for _ in range(200)]
    mixed = [draw.sample(t, len(t)) for t in clean[:40]]
    rows = [(k, "en", " ".join(t)) for k, t in enumerate([*clean, *mixed])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in kneser_ney.quality(docs, docs.where("doc_id < 200").select("doc_id")).collect()}
    assert sum(got[k].kept for k in range(200)) >= 190
    assert not any(got[k].kept for k in range(200, 240))


def test_rows_with_equal_and_null_ids(spark):
    rows = [(1, "en", "the cat sat"), (1, "en", "%% zz"), (None, "en", "the cat"), (None, None, None), (2, "de", "x " * 5000 + "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = kneser_ney.quality(docs, docs.where("doc_id = 1").select("doc_id")).collect()
    assert len(got) == 5 and sum(r.perplexity is None for r in got) == 1
    assert all(math.isfinite(r.perplexity) for r in got if r.perplexity is not None)


def test_thresholds_are_exact_ranks(spark):
    draw = random.Random(2)
    values = {lang: [draw.lognormvariate(1, 2) for _ in range(n)] for lang, n in (("en", 60_000), ("de", 7), (None, 1))}
    values["en"] += [3.0] * 20_000
    rows = [(lang, v) for lang, held in values.items() for v in held] + [("fr", None)]
    scored = spark.createDataFrame(rows, "lang string, perplexity double").repartition(7)
    for q in (0.98, 0.5, 1.0):
        wanted = {lang: sorted(held)[math.ceil(len(held) * q) - 1] for lang, held in values.items()}
        assert {r.lang: r.threshold for r in kneser_ney.exact_quantile(scored, q).collect()} == wanted


def test_every_trusted_document_sets_a_threshold(spark):
    docs = spark.createDataFrame([(k, f"lang{k}", "some words of a text") for k in range(20)], "doc_id long, lang string, text string")
    assert all(r.threshold is not None for r in kneser_ney.quality(docs, docs.select("doc_id")).collect())


def test_parts_and_rounds_give_the_scores_of_nested_dictionaries(spark):
    draw = random.Random(3)
    names = [f"w{k}" for k in range(60)]
    texts = [" ".join(draw.choices(names, [1 / (k + 1) for k in range(60)], k=draw.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    ids = docs.where("doc_id < 40").select("doc_id")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(word_ngrams.FOLDS)).alias("f")).collect()}
    size = sum(map(len, texts))
    assert word_ngrams.frequent_words(docs, size, 5)  # their pairs lie in several parts
    models = {f: plain_log_p([texts[k] for k in range(40) if fold[k] != f]) for f in range(word_ngrams.FOLDS)}
    for r in word_ngrams.score_words(docs, ids, Scratch(spark), 5).collect():
        w = ["", "", *word_ngrams.WORD.findall(texts[r.doc_id]), None]
        wanted = -sum(math.log(models[fold[r.doc_id]](g)) for g in zip(w, w[1:], w[2:])) / len(texts[r.doc_id].encode())
        assert abs(math.log(r.perplexity) - wanted) < 1e-6, r


def test_packed_trigrams_are_small_and_dealt_once():
    draw = random.Random(4)
    names = [f"word{k}" for k in range(3000)]
    chunk = word_ngrams._Chunk()
    texts = [draw.choices(names, [1 / (k + 1) for k in range(3000)], k=400) for _ in range(300)]
    for k, t in enumerate(texts):
        chunk.add(" ".join(t), k % 4, k % 3 == 0, b"x" * 33)
    row = chunk.row() | {"chunk": 7}
    often = word_ngrams.xxhash.xxh64_intdigest(b"word0")
    often -= (often >> 63) << 64
    blocks = [b for r in range(3) for b in word_ngrams._blocks(row, 6, {often: 4}, r, 3, False)]
    assert sorted(b["part"] for b in blocks) == list(range(6))
    assert sum(len(x) for b in blocks for x in b.values() if isinstance(x, bytes)) < 14 * chunk.size  # three longs are 24
    found = Counter()
    for b in blocks:
        for part in word_ngrams._slices([b]):
            ((_, docs, n),) = part.chunks
            assert n == 300 and (part.fold == docs % 4).all() and (part.trusted == (docs % 3 == 0)).all()
            found.update(zip(docs.tolist(), *(part.words[x].tolist() for x in (part.u, part.v, part.w))))
    coded = {x: (h := word_ngrams.xxhash.xxh64_intdigest(x.encode())) - ((h >> 63) << 64) for x in names}
    wanted = Counter()
    for k, t in enumerate(texts):
        w = [0, 0, *(coded[x] for x in t), 1]
        wanted.update((k, *g) for g in zip(w, w[1:], w[2:]))
    assert found == wanted
