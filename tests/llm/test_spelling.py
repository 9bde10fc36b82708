"""Spelling variants against a comparison of all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from murmuration.llm import spelling
from murmuration.llm.spelling import FrequencyTrie, spelling_variants
from tests.llm.cases import awkward, empty


def plain_words(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    words = plain_words(rows)
    forms, counts = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        counts[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, counts[w], words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def result(df, **options):
    found = spelling_variants(df, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def variants(seed, n_words, size):
    draw = random.Random(seed)
    letters = "abcdeéx"
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(n_words)]
    texts = []
    for _ in range(size):
        said = []
        for _ in range(200):
            w = draw.choice(stems)
            k, c = draw.randrange(len(w)), draw.choice(letters)
            said.append(draw.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w.upper()]))
        texts.append(" ".join(said))
    return texts


TEXTS = ["colour color colour color colour colour COLOR colr colr colr", "listen silent enlist tinsel listen silent enlist tinsel listen silent enlist tinsel",
         "abcde abcdef abcdefg " * 3, "chainaa " + "chainab " * 3 + "chaincb " * 9 + "chaincbd " * 30, "éàüßÿ éàüßÿ éàüßÿ éàüß× éàüß× éàüß×", "q" * 5000 + " " + "q" * 5001 + " " + "q" * 5000]


@pytest.mark.parametrize("options", [{}, {"shard_words": 3}])
def test_awkward_rows(spark, options):
    docs = awkward(spark, [*TEXTS * 3, *variants(1, 40, 20)]).repartition(3)
    want = expected(docs.collect())
    assert len(want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(docs, **options) == want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(docs.repartition(4), shard_words=200) == expected(docs.collect())


def test_empty_table(spark):
    assert spelling_variants(empty(spark)).count() == 0


def test_search_in_small_blocks_finds_all_pairs(monkeypatch):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("aeiourst") for _ in range(6)) for _ in range(1500)})
    short = sorted({w[:k] + w[k + 1 :] for w in words[::3] for k in (0, 3)})
    rows = [np.frombuffer("".join(ws).encode(), np.uint8).reshape(len(ws), -1) for ws in (words, short)]
    monkeypatch.setattr(spelling, "FRONTIER", 64)
    trie = FrequencyTrie(rows[0])
    for asked, names in zip(rows, (words, short)):
        got = [(names[a], words[trie.order[b]]) for left, right in trie.search(asked) for a, b in zip(left, right)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in names for b in words if near(a, b)}
