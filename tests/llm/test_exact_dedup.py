import hashlib
import re

from pyspark.sql import functions as F

from murmuration.llm.exact_dedup import exact_dedup
from tests.llm.cases import awkward, empty


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text or ""), []).append(r)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            kept = r.doc_id == best.doc_id and len(r.text or "") == len(best.text or "")
            out.append((r.doc_id, best.doc_id, len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    found = exact_dedup(df, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark, ["x y", "xy", "x  y", "x y"])
    assert result(docs) == expected(docs.collect())
    assert set(docs.columns) - {"kept"} <= set(exact_dedup(docs).columns)


def test_texts_that_share_a_hash_are_told_apart(spark):
    docs = awkward(spark, ["abc", "abd", "abe", "a b c"])
    assert result(docs, hashed=lambda text: F.length(text) % 2) == expected(docs.collect())


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0


def test_copies_are_combined_before_the_shuffle(spark):
    plan = exact_dedup(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "SortAggregate" not in plan and "Python" not in plan
