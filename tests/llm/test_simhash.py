import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from murmuration.llm import simhash
from murmuration.llm.components import connected_components
from murmuration.sources.scratch import Scratch
from tests.llm.cases import awkward, empty


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), seed=42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    smallest = {}
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    for k in keys:
        smallest.setdefault(find(k), set()).update(prints[k])
    return {k: min(smallest[find(k)], default=None) for k in keys}


def test_awkward_rows(spark):
    docs = awkward(spark, ["one two", "one two three", "One TWO  three", "a b c d e f g"])
    got = simhash.simhash_groups(docs).collect()
    rows = docs.collect()
    prints = {}
    for r in rows:
        prints.setdefault(plain_fingerprint(r.text), set()).update({r.doc_id} - {None})
    wanted = components(prints)
    assert sorted(((r.doc_id, r.simhash % 2**64, r.component_id) for r in got), key=str) == sorted(
        ((r.doc_id, p := plain_fingerprint(r.text), wanted[p]) for r in rows), key=str)
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("longest", [0, 3, 1000])
def test_links_connect_what_brute_force_connects(spark, longest):
    rng = random.Random(longest)
    values = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    values |= {0, 2**64 - 1, 1 << 63, (1 << 63) + 1}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "simhash long")
    found = simhash.links(df, longest=longest)
    roots = {r.node % 2**64: r.root for r in connected_components(found, Scratch(spark)).collect()}
    wanted = components({v: {k} for k, v in enumerate(sorted(values))})
    groups = {}
    for v in values:
        groups.setdefault(wanted[v], set()).add(roots.get(v, ("alone", v)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_position_sets_leave_out_every_pair():
    from itertools import combinations

    sets = simhash.position_sets(2)
    assert all(any(not set(pair) & set(s) for s in sets) for pair in combinations(range(8), 2))


def test_long_path_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(edges, Scratch(spark)).collect()} == {0}
