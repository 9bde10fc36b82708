"""Scalar functions, vectors, encoders and forward passes on tables small enough to do by hand."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from murmuration.functions import calendar, scalar, vectors
from murmuration.functions.draws import drawn_vector, hashed
from murmuration.functions.forward import forward
from murmuration.network import CLASSIFIER, LINEAR_REGRESSOR, REGRESSOR, Network
from murmuration.operators import clean, encode, metrics
from murmuration.operators.kernels import network_outputs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_relu_keeps_or_drops_nan(spark):
    nan = F.lit(float("nan"))
    assert math.isnan(one(spark, scalar.relu(nan)))
    assert one(spark, scalar.relu(nan, nan_to_zero=True)) == 0.0
    assert one(spark, scalar.relu(F.lit(-2.0))) == 0.0
    assert one(spark, scalar.relu(F.lit(2.5))) == 2.5


def test_threshold_of_nan_is_one(spark):
    assert one(spark, scalar.threshold(F.lit(float("nan")))) == 1.0
    assert one(spark, scalar.threshold(F.lit(0.5))) == 1.0
    assert one(spark, scalar.threshold(F.lit(0.4999))) == 0.0


def test_clip_and_clamp(spark):
    assert one(spark, scalar.clip_probability(F.lit(0.0))) == 1e-15
    assert one(spark, scalar.clip_probability(F.lit(1.0))) == 1 - 1e-15
    assert one(spark, scalar.clamp(F.lit(3.0), 0.48)) == 0.48
    assert one(spark, scalar.clamp(F.lit(-3.0), 0.48)) == -0.48


def test_fixed_text(spark):
    assert one(spark, scalar.fixed16(F.lit(27.042))) == "27.0420000000000000"
    assert one(spark, calendar.hour_label(F.lit(7))) == "07:00"


def test_calendar_text(spark):
    stamp = F.lit("2024-02-29 05:40")
    assert one(spark, calendar.day_text(stamp)) == "2024-02-29"
    assert one(spark, calendar.hour_text(calendar.time_text(stamp))) == "05"
    assert one(spark, calendar.minute_text(calendar.time_text(stamp))) == "40"
    assert one(spark, calendar.weekday_name(F.to_date(calendar.day_text(stamp)))) == "THURSDAY"
    assert one(spark, calendar.month_name(F.to_date(calendar.day_text(stamp)))) == "FEBRUARY"
    assert one(spark, calendar.iso_weekday(stamp.cast("timestamp"))) == 4


def test_one_hot_sums_to_one(spark):
    row = spark.range(1).select(
        vectors.one_hot(F.lit(3), range(1, 8)).alias("a"),
        vectors.one_hot(F.lit(9), range(1, 8)).alias("b"),
    ).first()
    assert row.a == [0, 0, 1, 0, 0, 0, 0] and sum(row.b) == 0


def test_first_seen_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "a")], "id long, v string")
    assert encode.vocabulary(df, "v", "id").first().words == ["c", "b", "a"]
    coded = df.select("id", encode.one_hot_first_seen(df, "v", "id").alias("x")).orderBy("id")
    assert [r.x for r in coded.collect()] == [[1, 0, 0], [0, 1, 0], [0, 1, 0], [0, 0, 1]]


def test_vocabulary_is_checked(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("v"))
    with pytest.raises(PySparkException):
        encode.vocabulary(df, "v", "id", max_size=10).collect()
    assert len(encode.vocabulary(df, "v", "id").first().words) == 50
    many = spark.range(20_000).select("id", F.col("id").cast("string").alias("v"))
    assert len(encode.vocabularies(many, ["v"], "id").first().v) == 20_000


def test_cut_append_dot(spark):
    x = F.array(*[F.lit(float(i)) for i in range(6)])
    assert one(spark, vectors.cut(x, 2, 3)) == [2.0, 3.0, 4.0]
    assert one(spark, vectors.append(x, F.lit(9)))[-1] == 9.0
    assert one(spark, vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0


X = [1.0, -2.0]
W = [0.5, 0.25, -1.0, 0.5, 2.0, -3.0]  # two hidden neurons: sums 0.0 and -2.0


@pytest.mark.parametrize("network,expected", [
    (Network("identity", "linear", n_hidden=2), 2.0 * 0.0 + -3.0 * -2.0),
    (Network("tanh", "linear", n_hidden=2), -3.0 * math.tanh(-2.0)),
    (Network("relu", "sigmoid", n_hidden=2), 0.5),
])
def test_tiny_net(spark, network, expected):
    import numpy as np

    x, w = (F.array(*[F.lit(v) for v in values]) for values in (X, W))
    assert one(spark, forward(x, w, 2, network)) == pytest.approx(expected, rel=1e-12)
    out = network_outputs(np.array([X]), np.array([W]), network.hidden, network.output, 1, 2)
    assert out[0, 0] == pytest.approx(expected, rel=1e-12)


def test_two_layers_by_hand(spark):
    import numpy as np

    net = Network("relu", "linear", layers=2, n_hidden=2)
    w = [1.0, 0.0, 0.0, -1.0] + [1.0, 1.0, 1.0, -1.0] + [2.0, 5.0]
    # first layer relu(1), relu(2) = 1, 2; second relu(3), relu(-1) = 3, 0; output 6
    x, ws = F.array(*[F.lit(v) for v in X]), F.array(*[F.lit(v) for v in w])
    assert one(spark, forward(x, ws, 2, net)) == 6.0
    assert network_outputs(np.array([X]), np.array([w]), "relu", "linear", 2, 2)[0, 0] == 6.0


def test_kernel_rejects_wrong_length():
    import numpy as np

    with pytest.raises(ValueError, match="weights"):
        network_outputs(np.ones((3, 2)), np.ones((1, 7)), "tanh", "linear", 1, 2)


def test_sizes():
    assert REGRESSOR.width(14) == 26 and REGRESSOR.n_weights(14) == 390
    assert CLASSIFIER.width(68) == 129 and CLASSIFIER.n_weights(68) == 8901
    assert LINEAR_REGRESSOR.n_weights(14) == 390


def test_hashed_draws_are_uniform_and_stable(spark):
    df = spark.range(200).select(F.col("id").alias("pid"), F.lit(3).alias("g"))
    drawn = df.select("pid", drawn_vector(hashed, 1, [F.col("g")], F.col("pid"), 1000, 2.0).alias("x"))
    one_way = {r.pid: r.x for r in drawn.collect()}
    other = df.repartition(7).select("pid", drawn_vector(hashed, 1, [F.col("g")], F.col("pid"), 1000, 2.0).alias("x"))
    assert one_way == {r.pid: r.x for r in other.collect()}
    values = sorted(v for x in one_way.values() for v in x)
    assert -2.0 <= values[0] and values[-1] < 2.0 and abs(sum(values) / len(values)) < 0.02
    gap = max(abs((v + 2) / 4 - i / len(values)) for i, v in enumerate(values))
    assert gap < 0.005  # 200,000 draws lie close to the uniform distribution


def test_complete_rows(spark):
    rows = [("a", "1"), ("", "2"), (" ", "3"), (None, "4"), ("b", "5")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert [r.y for r in clean.complete_rows(df).collect()] == ["1", "5"]


def test_bad_label_stops(spark):
    df = spark.createDataFrame([("0",), ("2",)], "c string")
    with pytest.raises(PySparkException):
        df.select(clean.decode_label(F.col("c"))).collect()


def test_bad_number_stops(spark):
    df = spark.createDataFrame([("1.5",), ("x",)], "c string")
    with pytest.raises(PySparkException):
        df.select(F.col("c").cast("double")).collect()


@pytest.mark.parametrize("n", [1, 60, 99_999, 150_000, 260_000, 400_000])
def test_first_rows_of_any_number(spark, n):
    """Unknown keys come first, many keys are equal, a dominating one among them, some rows are equal altogether."""
    k = F.col("id")
    key = F.when(k % 50 == 0, None).when(k % 2 == 0, 7).otherwise((k * 7919) % 1_003)
    df = spark.range(300_000).select(key.cast("int").alias("key"), (k % 11).alias("other")).cache()
    counts = {tuple(r)[0]: r["count"] for r in df.groupBy("key").count().collect()}
    got = {tuple(r)[0]: r["count"] for r in clean.first_rows(df, n, "key").groupBy("key").count().collect()}
    left, expected = n, {}
    for value in sorted(counts, key=lambda v: (v is not None, v or 0)):
        if take := min(left, counts[value]):
            expected[value] = take
        left -= take
    assert got == expected


def test_first_rows_of_texts(spark):
    df = spark.range(200_000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("key"))
    assert clean.first_rows(df, 120_000, "key").agg(F.max("key"), F.count("*")).first()[:] == ("000119999", 120_000)


def test_unknown_probabilities_stay_unknown(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, None)], "real double, score double")
    assert metrics.cross_entropy(df).first().bce == pytest.approx(0.6931471805599453)
    assert one(spark, scalar.clip_probability(F.lit(None).cast("double"))) is None
    assert one(spark, scalar.clip_probability(F.lit(float("nan")))) != one(spark, scalar.clip_probability(F.lit(1.0)))
    ranked = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, None), (None, 0.5)], "real double, score double")
    for mode, value in (("rank", 1.0), ("literal", 0.5)):
        found = metrics.auc(ranked, mode=mode).first()
        assert (found.positives, found.auc) == (1, value)


def test_leading_features(spark):
    df = spark.createDataFrame([("1", "2", "0")], "a string, b string, label string")
    x, label = clean.leading_features(df, 2)
    row = df.select(x.alias("x"), label.alias("label")).first()
    assert row.x == [1.0, 2.0] and row.label == "0"
    with pytest.raises(ValueError):
        clean.leading_features(df, 3)
