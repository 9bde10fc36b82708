"""Vocabularies numbered by ranges, sparse vectors, and the running best of groups that are split."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import encode, swarm, wide
from murmuration.sources.scratch import Scratch


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one value; some have none."""
    draw = random.Random(3)
    rows = [(k, None if draw.random() < 0.1 else "hot" if draw.random() < 0.4 else f"v{draw.randrange(4000)}", draw.random())
            for k in range(20_000)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "row_id long, name string, z double").repartition(7)


def plain_numbers(rows):
    words = {}
    for _, name, _ in sorted(rows, key=lambda r: r[0]):
        if name is not None:
            words.setdefault(name, len(words))
    return words


def test_numbers_follow_first_appearance(spark, skewed):
    rows, df = skewed
    got = wide.number_values(df, "name", "row_id")
    assert {r.value: r.number for r in got.collect()} == plain_numbers(rows)
    assert {r.value: r.n for r in got.where("value = 'hot'").collect()} == {"hot": sum(r[1] == "hot" for r in rows)}
    assert got.collect() == got.collect()


def test_numbers_of_rows_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (1,), (1,), (2,)], "a int").repartition(3)
    got = [(r.a, r.number) for r in wide.number_rows(df, ["a"], Scratch(spark)).orderBy("number").collect()]
    assert got == [(None, 0), (1, 1), (1, 2), (1, 3), (2, 4), (3, 5)]
    assert wide.number_rows(df.limit(0), ["a"], Scratch(spark)).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_look_up_with_and_without_broadcast(spark, skewed, limit):
    rows, df = skewed
    words = plain_numbers(rows)
    got = wide.look_up(df, "name", wide.number_values(df, "name", "row_id"), broadcast_bytes=limit)
    assert {(r.row_id, r.name, r.number) for r in got.collect()} == {(k, n, words.get(n)) for k, n, _ in rows}
    assert got.count() == len(rows)


def test_hot_values_and_nulls_are_split(spark, skewed):
    _, df = skewed
    met = wide.look_up(df, "name", wide.number_values(df, "name", "row_id"), broadcast_bytes=0)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert largest < 0.3 * 20_000  # four partitions: the hot value alone is more than a third


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_sparse_features_equal_dense_ones(spark, limit):
    draw = random.Random(5)
    rows = [(k, draw.choice("abcde"), draw.choice(["x", "y"]), draw.choice([None, 1.5, 2.0])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, z double").repartition(5)
    wanted = {r.id: r.x for r in encode.assemble_features(df, ["a", "b"], ["z", "id"], "id").collect()}
    got = wide.assemble_sparse(df, ["a", "b"], ["z", "id"], "id", broadcast_bytes=limit)
    assert got.columns == ["id", "a", "b", "z", "x"]
    assert {r.id: r.x for r in got.select("id", wide.dense(F.col("x")).alias("x")).collect()} == wanted


def test_unknown_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id long, a string")
    got = {r.id: r.x for r in wide.assemble_sparse(df, ["a"], [], "id").collect()}
    assert (got[1].size, got[1].indices, got[1]["values"]) == (1, [], [])
    assert (got[2].size, got[2].indices, got[2]["values"]) == (1, [0], [1.0])
    assert wide.assemble_sparse(df.limit(0), ["a"], ["id"], "id").count() == 0
    with pytest.raises(ValueError):
        wide.look_up(df, "a", wide.number_values(df, "a", "id"), output="id")


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_sparse_scores(spark, skewed, limit):
    rows, df = skewed
    words = plain_numbers(rows)
    weights = {i: i % 17 - 3.0 for i in range(0, len(words), 2)}
    table = spark.createDataFrame(list(weights.items()), "index long, weight double")
    x = wide.assemble_sparse(df, ["name"], ["z"], "row_id")
    got = {r.row_id: r.score for r in wide.sparse_scores(x, ["row_id"], "x", table, limit).collect()}
    z = weights.get(len(words), 0.0)
    for k, name, value in rows:
        assert got[k] == pytest.approx((weights.get(words[name], 0.0) if name is not None else 0.0) + z * value)


def plain_best(rows, running):
    out, best = {}, {}
    for g, pid, fit in sorted(rows):
        best[g] = min(best.get(g, (fit, pid)), (fit, pid))
        out[g, pid] = best[g]
    return {k: ((v if running else best[k[0]]), best[k[0]]) for k, v in out.items()}


@pytest.mark.parametrize("running", [True, False])
@pytest.mark.parametrize("span", [1, 4, 1 << 16])
def test_best_of_groups_in_spans(spark, monkeypatch, running, span):
    monkeypatch.setattr(swarm, "SPAN", span)
    draw = random.Random(7)
    rows = [(g, pid, float(draw.randrange(5)) if pid >= 0 else float("inf")) for g in range(3) for pid in range(-1, 37 - g)]
    fits = spark.createDataFrame(rows, "grp int, pid long, pbest_fit double").repartition(5)
    got = swarm.best_seen(fits, ["grp"], running).collect()
    assert len(got) == len(rows)
    assert {(r.grp, r.pid): ((r.best_fit, r.best_pid), (r.lead_fit, r.lead_pid)) for r in got} == plain_best(rows, running)


def test_one_large_group_is_many_tasks(spark):
    fits = spark.range(2_000_000).select(F.lit(1).alias("grp"), F.col("id").alias("pid"), F.rand(1).alias("pbest_fit"))
    seen = swarm.best_seen(fits, ["grp"], True)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put so few bytes into one task again
    try:
        parts = [r["count"] for r in seen.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(parts) == 2_000_000 and max(parts) < 1_500_000


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_sparse_scores_of_repeated_and_null_keys(spark, limit):
    """One score per row, though keys, even whole rows, come twice; unknown entries count as zero."""
    rows = [(1, [0, 2], [1.0, 3.0]), (1, [0, 2], [1.0, 3.0]), (1, [1], [1.0]), (None, [2], [None]), (None, [7], [1.0]), (2, [], []),
            (3, [None, 1], [4.0, 2.0]), (4, None, None)]
    df = spark.createDataFrame([(k, None if i is None else (9, i, v)) for k, i, v in rows], f"id long, x {wide.SPARSE}").repartition(3)
    weights = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, 1.0), (1, 1.0), (3, None), (None, 9.0)], "index long, weight double")
    got = sorted(((r.id is None, r.id or 0), r.score) for r in wide.sparse_scores(df, ["id"], "x", weights, limit).collect())
    assert got == [((False, 1), 3.0), ((False, 1), 3.5), ((False, 1), 3.5), ((False, 2), 0.0), ((False, 3), 6.0), ((False, 4), 0.0),
                   ((True, 0), 0.0), ((True, 0), 0.0)]
    assert wide.sparse_scores(df.limit(0), ["id"], "x", weights, limit).count() == 0
    assert {r.score for r in wide.sparse_scores(df, ["id"], "x", weights.limit(0), limit).collect()} == {0.0}
