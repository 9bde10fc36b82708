"""Line dedup against plain counting."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from murmuration.llm import line_dedup
from murmuration.llm.line_dedup import LineIndex, build_shard, drop_repeated_lines
from tests.llm.cases import awkward, empty

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    line = line.strip(WHITE)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def expected(rows, min_docs):
    counts = Counter()
    for r in rows:
        counts.update({key(x) for x in (r.text or "").split("\n")})
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if not key(x) or counts[key(x)] < min_docs]
        out.append((r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def result(df, **options):
    found = drop_repeated_lines(df, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


TEXTS = ["one\nTWO\nthree", " two \n\n\nONE\t", "two\r\nfour", "Été\néTÉ", "été\n two", "two", "two\n" * 3000 + "end", "\n", "one"]


@pytest.mark.parametrize("options", [{}, {"index_bytes": 0}, {"shard_keys": 2}])
@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_awkward_rows(spark, options, min_docs):
    docs = awkward(spark, TEXTS).repartition(3)
    assert result(docs, min_docs=min_docs, **options) == expected(docs.collect(), min_docs)
    assert set(docs.columns) <= set(drop_repeated_lines(docs, **options).columns)


def test_empty_table(spark):
    assert drop_repeated_lines(empty(spark)).count() == 0
    assert drop_repeated_lines(empty(spark), index_bytes=0).count() == 0


def test_a_table_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = expected(docs.collect(), 3)
    assert result(docs, min_docs=3) == want == result(docs, min_docs=3, index_bytes=0)
    assert any(r[2] for r in want)


def test_a_line_in_every_row(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('Shared line\n', 'own ', id, '\n shared LINE ') AS text")
    assert all(r.n_dropped == 2 and r.kept == f"own {r.doc_id}" for r in drop_repeated_lines(docs.repartition(8)).collect())


def test_the_perfect_hash_is_minimal_and_knows_strangers():
    draw = np.random.default_rng(1)
    hi, lo = draw.integers(0, 2**63, (2, 30_000)).astype(np.uint64)
    hi[:100] = hi[0]  # equal halves
    counts = draw.integers(1, 1000, len(hi))
    shards, rows = 3, []
    for s in range(shards):
        mine = np.mod(hi.view(np.int64), shards) == s
        if mine.any():
            sizes, bits, prints, numbers = build_shard(hi[mine], lo[mine], counts[mine])
            assert len(prints) == 8 * mine.sum() and set(np.frombuffer(prints, np.uint64)) == set(lo[mine])
            assert len(bits) < 0.75 * mine.sum()
            rows.append({"shard": s, "n": int(mine.sum()), "sizes": sizes, "bits": bits, "fingerprints": prints, "counts": numbers})
    index = LineIndex(pa.Table.from_pylist(rows), shards)
    assert (index.count(hi, lo) == counts).all()
    assert not index.count(hi[::-1].copy(), lo).any() or (hi[::-1] == hi).any()
    assert not index.count(*draw.integers(0, 2**63, (2, 30_000)).astype(np.uint64)).any()


def test_hashes_are_of_128_bits():
    hi, lo = line_dedup._digests([b"a", b"b"])
    assert len({*hi.tolist(), *lo.tolist()}) == 4
