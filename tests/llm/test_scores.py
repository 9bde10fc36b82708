"""Toxicity and quality."""

import math
from collections import Counter

import pytest

from murmuration.llm import kneser_ney, queries, toxicity
from murmuration.sources.scratch import Scratch
from tests.llm.cases import awkward, empty


def test_toxicity_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    known = queries.table(spark, sf, "labels").withColumn("low_quality", 1 - queries.F.col("quality"))
    training = docs.join(known.where("doc_id % 4 <> 1"), "doc_id")
    chain = toxicity.fit_chain(training, ["low_quality", "toxic"])
    assert chain.models[1].earlier.shape == (1,) and chain.models[1].earlier[0] != 0
    got = toxicity.score_toxicity(docs.where("doc_id % 4 = 1"), chain).where("doc_id is not null").collect()
    held = [r for r in got if r.doc_id in labels]
    hit = sum(r.is_toxic and labels[r.doc_id] == 1 for r in held)
    assert hit >= 0.8 * sum(labels[r.doc_id] for r in held)
    assert hit >= 0.9 * sum(r.is_toxic for r in held)


def test_toxicity_of_awkward_rows(spark):
    bad = [(k, f"you idiot number{k}", 1) for k in range(20)] + [(100 + k, f"fine words number{k}", 0) for k in range(40)]
    labelled = spark.createDataFrame([*bad, (999, None, 1), (998, "x", None)], "doc_id long, text string, toxic int")
    chain = toxicity.fit_chain(labelled, ["toxic"])
    got = {r.doc_id: r for r in toxicity.score_toxicity(awkward(spark, ["such an IDIOT", "fine words"]), chain).collect()}
    assert got[100].is_toxic and not got[101].is_toxic and not got[8].is_toxic and not got[1].is_toxic
    assert toxicity.score_toxicity(empty(spark), chain).count() == 0
    nothing = toxicity.fit_chain(labelled.limit(0), ["toxic"])
    assert not any(r.is_toxic for r in toxicity.score_toxicity(awkward(spark), nothing).collect())


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by nested dictionaries."""
    levels = {order: Counter()}
    for t in texts:
        padded = kneser_ney.START * (order - 1) + t
        levels[order].update(padded[k : k + order] for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, contexts = {}, {}
    for k, counts in levels.items():
        n = [sum(c == j for c in counts.values()) for j in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0]
            cuts[k] = [min(max(a, 0.05), b) for a, b in zip(d, (0.95, 1.9, 2.9))]
        else:
            cuts[k] = [0.5] * 3
        for g, c in counts.items():
            total, free = contexts.get((k, g[:-1]), (0, 0.0))
            contexts[k, g[:-1]] = total + c, free + cuts[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        below = p(gram[1:]) if k > 1 else 1 / 256
        if (k, gram[:-1]) not in contexts:
            return below
        total, free = contexts[k, gram[:-1]]
        c = levels[k].get(gram, 0)
        return (c - cuts[k][min(c, 3) - 1] if c else 0) / total + free / total * below

    return p


@pytest.mark.parametrize("shard_rows", [40, 10**6])
def test_perplexity_against_plain_model(spark, shard_rows):
    texts = ["the cat sat on the mat", "the dog sat on the log", "été à la mer", "", "\n\nthe end"]
    train = spark.createDataFrame([(t.encode(),) for t in texts], "bytes binary")
    model = kneser_ney.fit_model(train, Scratch(spark), 4)
    p = plain_model([t.encode() for t in texts], 4)
    for r in kneser_ney.score_documents(awkward(spark, texts), model, shard_rows=shard_rows).collect():
        if not r.text:
            assert r.perplexity is None
            continue
        data = r.text.encode()[:3000] if r.doc_id != 8 else None
        if data is None:
            continue
        padded = kneser_ney.START * 3 + data
        wanted = -sum(math.log(p(padded[k : k + 4])) for k in range(len(data))) / len(data)
        assert abs(math.log(r.perplexity) - wanted) < 1e-4


def test_probabilities_sum_to_one():
    p = plain_model([b"abracadabra", b"banana"], 3)
    assert abs(sum(p(b"an" + bytes([k])) for k in range(256)) - 1) < 1e-9


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark, ["the same words once more", "%%$$ @@ ~~ ^^ ||| <<<", *["the same words and more words"] * 40])
    trusted = spark.createDataFrame([(5,), (5,), (None,), (12345,), *[(102 + k,) for k in range(40)]], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.quality(docs, trusted).collect()}
    assert got[110].kept and not got[101].kept and not got[1].kept and got[3].perplexity is not None
    assert got[10].threshold is None and got[10].kept
    assert kneser_ney.quality(empty(spark), trusted).count() == 0


def test_quality_keeps_clean_documents_and_drops_noise(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op9_quality(spark, sf).collect()
    kept = {q: [r.kept for r in got if good.get(r.doc_id) == q] for q in (0, 1)}
    assert sum(r.kept for r in got) > 0.7 * len(got)
    assert sum(kept[1]) > 0.9 * len(kept[1]) and sum(kept[0]) < 0.5 * len(kept[0])
