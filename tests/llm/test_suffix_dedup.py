import random

import numpy as np
import pytest

from murmuration.llm import suffix_dedup
from tests.llm.cases import awkward, empty


def expected(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for k in range(len(d) - width + 1):
            seen[d[k : k + width]] = seen.get(d[k : k + width], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = True
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), edges, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def compare(docs, **options):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
                  for r in suffix_dedup.remove_repeats(docs, **options).collect()), key=str)
    rows = docs.select("doc_id", "text").collect()
    wanted = expected([r.text for r in rows], options["width"])
    assert got == sorted(((r.doc_id, *w) for r, w in zip(rows, wanted)), key=str)


def passages(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 150))) for _ in range(6)]
    return ["".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(1, 120)] for _ in range(rng.randint(0, 5)))
            for _ in range(n)]


@pytest.mark.parametrize("many", [1, 1000])
def test_random_passages(spark, many):
    compare(awkward(spark, [*passages(many, 60), "ab" * 60, "x" * 200]), width=40, gram=8, many=many)


def test_production_width(spark):
    a, b = "".join(passages(7, 9))[:450], "".join(passages(8, 9))[:450]
    compare(awkward(spark, [a, b[:230] + a[100:350] + b[230:], a[:199] + "!", "§" + b[5:210]]), width=200)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_sorting_finds_exactly_the_repeated_strings():
    rng = random.Random(0)
    for width in (5, 8, 13, 40):
        data = bytes(rng.choice(b"ab") for _ in range(400))
        begin = np.array([k for k in range(0, 400 - width + 1) if rng.random() < 0.7])
        strings = [data[k : k + width] for k in begin]
        got = suffix_dedup.repeated_strings(np.frombuffer(data, np.uint8), begin, width)
        assert got.tolist() == [strings.count(s) > 1 for s in strings]


def test_equal_strings_have_equal_anchors():
    texts = [t.encode() for t in passages(3, 30)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    begin, count, key = suffix_dedup.runs(data, bounds, 40, 8)
    every = [k for b, c in zip(begin.tolist(), count.tolist()) for k in range(b, b + c)]
    assert sorted(every) == [k for a, z in zip(bounds, bounds[1:]) for k in range(a, z - 39)]
    keys = {}
    for b, c, h in zip(begin.tolist(), count.tolist(), key.tolist()):
        for k in range(b, b + c):
            assert keys.setdefault(data[k : k + 40].tobytes(), h) == h


def test_rows_that_repeat_gather_their_spans_once(spark):
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(300))
    rows = spark.createDataFrame([(7, text)] * 400 + [(8, "other " + text[:250])], "doc_id long, text string").repartition(4)
    found = suffix_dedup.remove_repeats(rows).collect()
    assert len(found) == 401 and {(r.doc_id, r.n_removed, len(r.spans)) for r in found} == {(7, 300, 1), (8, 250, 1)}
