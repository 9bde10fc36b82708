"""Collocations against plain counting."""

import re
import tracemalloc
from collections import Counter, defaultdict
from glob import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from murmuration.llm import phrases
from murmuration.llm.phrases import collocations, double_array
from murmuration.sources.scratch import Scratch
from tests.llm.cases import awkward, empty


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows, min_count, top, covered=80):
    f, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(r.text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= min_count and " " in p}
        hidden = set()
        for p, a in kept.items():
            words = p.split(" ")
            for k in range(2, len(words)):
                for i in range(len(words) - k + 1):
                    inner = " ".join(words[i : i + k])
                    if 100 * a >= covered * counts[inner]:
                        hidden.add(inner)
        found = []
        for p, a in kept.items():
            if p not in hidden:
                words = p.split(" ")
                cuts = []
                for k in range(1, len(words)):
                    left, right = counts[" ".join(words[:k])], counts[" ".join(words[k:])]
                    cuts.append((2000000 * a // (left + right), k, left, right))
                score, _, left, right = min(cuts)
                found.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def result(df, **options):
    found = collocations(df, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


TEXTS = ["New York is big, New York is loud. new\tyork is far", "a a a a a a. a a a", "big New  York is big\nNew York; is", "été à la mer à la mer",
         "one two three four five " * 9, "two three four", "x\x1cy z x\x1cy z x\x1cy z", "\x00 b \x00 b \x00 b", "..,,!!", "a-b a-b a-b\x85 a-b"]


@pytest.mark.parametrize("options", [{}, {"shard_phrases": 20_000}])
@pytest.mark.parametrize("min_count", [2, 3])
def test_awkward_rows(spark, options, min_count):
    docs = awkward(spark, TEXTS).repartition(3)
    assert result(docs, min_count=min_count, top=50, **options) == expected(docs.collect(), min_count, 50)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    want = expected(docs.collect(), 8, 2000)
    assert len(want) > 100 and any(len(r[2].split()) == 4 for r in want)
    assert result(docs.repartition(5), min_count=8) == want


def test_pieces_longer_than_a_chunk(spark, monkeypatch):
    rows = [(1, "one two three. " * 300 + "four five " * 300, "en"), (2, "one two " * 50, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = list(phrases.token_lists(iter(docs.select("lang", "text").toArrow().to_batches())))
    monkeypatch.setattr(phrases, "CHUNK", 100)
    cut = list(phrases.token_lists(iter(docs.select("lang", "text").toArrow().to_batches())))
    assert len(cut) > 40

    def pieces(lists):
        return Counter((lang, p.strip()) for lang, tokens in lists for p in b" ".join(tokens).split(b"\xff") if p.strip())

    assert pieces(found) == pieces(cut)
    assert result(docs, top=9) == expected(docs.collect(), 30, 9)


def test_empty_table(spark):
    assert collocations(empty(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 9_000_000_000_000
    row = spark.sql(f"SELECT (CAST({a}L AS DECIMAL(20, 0)) * 2000000BD) DIV ({a}L + {a + 1}L) AS s").first()
    assert row.s == 2000000 * a // (2 * a + 1)


def test_double_array():
    draw = np.random.default_rng(3)
    sequences = [list(s) for s in {tuple(draw.integers(1, 40, draw.integers(2, 5)).tolist()) for _ in range(3000)}]
    base, check, accept = double_array(sequences, 39)
    for number, sequence in enumerate(sequences):
        state = 0
        for c in sequence:
            to = base[state] + c
            assert check[to] == state
            state = to
        assert accept[state] == number
    assert (accept >= 0).sum() == len(sequences)
    nodes = {tuple(s[:k]) for s in sequences for k in range(len(s) + 1)}
    assert (check >= 0).sum() == len(nodes) - 1


def test_chunks_do_not_depend_on_batches():
    batch = pa.record_batch({"lang": ["en", None, "de", "en"] * 500, "text": ["one two. three", "x", None, "four five"] * 500})
    small = [batch.slice(k, 3) for k in range(0, batch.num_rows, 3)]
    assert list(phrases.token_lists(iter(small))) == list(phrases.token_lists(iter([batch])))
    assert len(list(phrases.token_lists(iter(small)))) == 3


def test_waiting_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 100)
    monkeypatch.setattr(phrases, "CHUNKS_HELD", 2)
    rows = [(f"lang {k}", "one two three four") for k in range(50)] * 2
    taken = []

    def batches():
        for lang, text in rows:
            taken.append(lang)
            yield pa.record_batch({"lang": [lang], "text": [text]})

    found = []
    for lang, tokens in phrases.token_lists(batches()):
        found.append((lang, tokens))
        assert (len(taken) - len(found)) * 19 <= 200 + 19
    assert Counter(lang for lang, _ in found) == Counter(lang for lang, _ in rows)


def test_few_chunks_are_in_memory_at_once(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(f"{k}", f"one two three w{k}. ") for k in range(30)], "lang string, text string").coalesce(1)
    tables, batches = {}, []
    stored = phrases.stored

    def noted(df, scratch, name, *options):
        tables[name] = scratch.path(name).removeprefix("file:")
        return stored(df, scratch, name, *options)

    def rows(chunks):
        def worker(found):
            for batch in found:
                yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

        return chunks.mapInArrow(worker, "n long")

    def counted(chunks, *options, plain=phrases.count_words):
        batches.extend(r.n for r in phrases.from_chunks(rows(chunks), Scratch(spark), "rows").collect())
        return plain(chunks, *options)

    monkeypatch.setattr(phrases, "stored", noted)
    monkeypatch.setattr(phrases, "count_words", counted)
    assert collocations(docs, min_count=1).count() == 30
    files = [pq.ParquetFile(f).metadata for f in glob(f"{tables['chunks']}/*.parquet")]
    groups = [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) == 30 and max(groups) <= phrases.CHUNKS_AT_ONCE
    assert sum(batches) == 30 and max(batches) <= phrases.CHUNKS_AT_ONCE
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_packed_places():
    for places in ([], [-1], [0, -1, 255, 256, 65535, 2**24, 2**31 - 2]):
        got = phrases.unpacked(phrases.packed(np.array(places, np.int32)))
        assert got.tolist() == places and got.dtype == np.int32


def test_memory_of_a_trie():
    draw = np.random.default_rng(5)
    sequences = [list(s) for s in {tuple(draw.integers(1, 2000, 4).tolist()) for _ in range(20_000)}]
    tracemalloc.start()
    base, _, _ = double_array(sequences, 2000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 200 * len(base)
