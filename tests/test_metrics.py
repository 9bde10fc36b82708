"""Metrics: hand-made pairs, empty denominators, literal forms and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import metrics

TINY = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4), (0, 0.3), (1, 0.2)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(float(y), s) for y, s in TINY], "real double, score double")


@pytest.fixture(scope="module")
def one_class(spark):
    return spark.createDataFrame([(1.0, 0.3, 0.0), (1.0, 0.7, 0.0)], "real double, score double, predicted double")


def test_auc_values(tiny):
    assert metrics.auc(tiny).first().auc == 0.625
    assert metrics.auc(tiny, mode="literal").first().auc == 0.125


def test_auc_is_invariant_under_monotone_maps(tiny):
    mapped = tiny.withColumn("score", F.exp(F.col("score") * 5))
    assert metrics.auc(mapped).first().auc == 0.625
    constant = tiny.withColumn("score", F.lit(1.0))
    assert metrics.auc(constant).first().auc == 0.5


def test_auc_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.random() < 0.3), round(rng.random() * (0.2 if g == 1 else 2), 2))
            for g in (1, 2) for _ in range(1500)]
    got = {r.g: r.auc for r in metrics.auc(
        spark.createDataFrame(rows, "g int, real double, score double").repartition(5), by=["g"]).collect()}
    for g in (1, 2):
        pos = [s for k, y, s in rows if k == g and y == 1]
        neg = [s for k, y, s in rows if k == g and y == 0]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)), rel=1e-12)


def test_one_class_is_undefined(one_class):
    assert metrics.auc(one_class).first().auc is None
    assert metrics.f1(one_class).first().f1 is None
    assert math.isnan(metrics.f1(one_class, empty="nan").first().f1)


def test_sums_and_rates(tiny):
    decided = tiny.withColumn("predicted", F.when(F.col("score") < 0.5, 0.0).otherwise(1.0))
    assert metrics.accuracy(decided).first().accuracy == 5 / 8
    assert metrics.error_rate(decided).first().error == 3 / 8
    counts = metrics.class_counts(decided).first()
    assert (counts.n_rows, counts.real_ones, counts.predicted_ones) == (8, 4, 5)
    f1 = metrics.f1(decided).first()
    assert (f1.tp, f1.fp, f1.fn) == (3, 2, 1) and f1.f1 == pytest.approx(2 / 3)
    expected = -sum(math.log(s) if y else math.log(1 - s) for y, s in TINY)
    assert metrics.cross_entropy(tiny).first().bce == pytest.approx(expected)


def test_signum_decision_predicts_all_positive(spark, tiny):
    decided = tiny.withColumn("predicted", F.signum("score"))
    positives, negatives = 4, 4
    loss = 1 - metrics.f1(decided).first().f1
    assert loss == pytest.approx(negatives / (2 * positives + negatives))


def test_macro_is_unweighted(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (0, 1.0, 0.0), (1, 3.0, 0.0)],
                               "grp int, real double, predicted double")
    assert metrics.macro_mse(df, ["grp"]).first().macro_mse == 5.0
    assert metrics.mse(df).first().mse == 3.0
