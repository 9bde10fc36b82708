import random
import re

from murmuration.llm.decontaminate import benchmark_matches
from tests.llm.cases import LONG, awkward, empty


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, window):
    out = []
    for doc in docs:
        w, hit, ids = words(doc.text), set(), set()
        for item_id, text in items:
            iw = words(text)
            size = min(window, len(iw))
            wanted = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
            for p in range(len(w) - size + 1) if wanted else ():
                if tuple(w[p : p + size]) in wanted:
                    hit |= set(range(p, p + size))
                    ids.add(item_id)
        out.append((doc.doc_id, len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items, window):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_matches(docs, benchmark, window)
    got = [(r.doc_id, r.n_words, r.n_hit, {m.item_id for m in r.matches}, r.contaminated) for r in found.collect()]
    assert sorted(got, key=str) == expected(docs.collect(), items, window)
    return found


def test_random_passages(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(60)]
    items = [(k, " ".join(rng.choices("aB", k=rng.randint(0, 14)))) for k in range(12)] + [(None, "b b b a"), (3, None), (90, "never")]
    check(spark, awkward(spark, texts), items, 6)


def test_awkward_rows_and_locations(spark):
    inside = "x1 y1 z1 " + " ".join(f"w{k}" for k in range(20)) + ". tail"
    passage = " ".join(f"W{k}" for k in range(20))
    docs = awkward(spark, [inside, passage + " " + passage, "w1 w2", "été,über naïve"])
    items = [(1, passage), (2, "été über"), (2, LONG[:300]), (4, "")]
    found = check(spark, docs, items, 13)
    matches = {r.doc_id: [tuple(m) for m in r.matches] for r in found.collect()}
    assert matches[100] == [(1, 0, 3, 20)]
    assert sorted(matches[101]) == [(1, 0, 0, 20), (1, 0, 20, 20)]


def test_blocks_give_the_same(spark, monkeypatch):
    from murmuration.llm import decontaminate

    docs = awkward(spark, ["a b c d e f", "c d e f g h"])
    items = [(k, f"{a} {b} {c}") for k, (a, b, c) in enumerate(zip("abcdef", "bcdefg", "cdefgh"))]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 5)
    check(spark, docs, items, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_matches(empty(spark), none).count() == 0
    assert {r.n_hit for r in benchmark_matches(awkward(spark), none).collect()} == {0}
