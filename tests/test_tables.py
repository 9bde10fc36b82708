"""Readers, writers and the two problems from text file to evaluated model."""

import random
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from murmuration import SwarmSettings, evaluate, fit
from murmuration.network import CLASSIFIER, REGRESSOR, Network
from murmuration.operators import metrics
from murmuration.operators.score import predict
from murmuration.plans.features import (
    DEMAND_COLUMNS,
    SMOKER_COLUMNS,
    calendar_features,
    demand_table,
    health_table,
    labelled_table,
)
from murmuration.sources import sinks, text
from murmuration.sources.scratch import Scratch, scratch_root


@pytest.fixture(scope="module")
def demand_file(tmp_path_factory):
    """Ten-minute rows from 05:00 on, without any row of hour 9, with blank cells in two rows."""
    rng = random.Random(1)
    lines = ["id,real,x,programmed,stamp"]
    for day in range(1, 9):
        for minute in range(5 * 60, 24 * 60, 10):
            if minute // 60 == 9:
                continue
            real = 20 + rng.random()
            stamp = f"2024-01-{day:02d} {minute // 60:02d}:{minute % 60:02d}"
            lines.append(f" {len(lines)} , {real:.3f},k, {real + rng.random():.3f} ,{stamp}")
    lines.insert(3, "7,1.0,,2.0,2024-01-01 05:20")
    lines.insert(9, "8,1.0,k,,")
    path = tmp_path_factory.mktemp("demand") / "demand.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_demand_table(spark, demand_file):
    raw = text.read_delimited(spark, demand_file, DEMAND_COLUMNS)
    assert raw.count() == 8 * 18 * 6 + 2
    table = demand_table(raw).cache()
    assert table.count() == 8 * 18 * 6  # both rows with blank cells are gone, also the one ending in blanks
    assert sorted(r.grp for r in table.select("grp").distinct().collect()) == [h for h in range(5, 24) if h != 9]
    assert table.select(F.size("x")).distinct().first()[0] == 14
    sums = table.select(F.aggregate(F.slice("x", 1, 13), F.lit(0.0), lambda a, b: a + b).alias("s")).distinct()
    assert [r.s for r in sums.collect()] == [2.0]
    first = table.orderBy("row_id").first()
    assert first.grp == 5 and first.x[:13] == [1.0] + [0.0] * 6 + [1.0] + [0.0] * 5  # a Monday, 05:00
    seen = demand_table(raw, vocabulary="first_seen")
    assert seen.select(F.size("x")).distinct().first()[0] == 14
    limited = demand_table(raw, limit=100)
    assert limited.count() == 100
    assert limited.agg(F.max("row_id")).first()[0] == sorted(r.row_id for r in table.collect())[99]


def test_train_score_and_write_demand(spark, demand_file, tmp_path):
    table = demand_table(text.read_delimited(spark, demand_file, DEMAND_COLUMNS)).cache()
    trained = fit(table, ["grp"], REGRESSOR, "mse", particles=6, iterations=3, init_range=2.0, v_max=1.0)
    scored = predict(table, trained.weights, ["grp"], REGRESSOR, 14).cache()
    assert scored.count() == table.count()

    path = str(tmp_path)
    sinks.write_curve(trained.curve, f"{path}/curve")
    assert spark.read.parquet(f"{path}/curve").count() == 18 * 3
    sinks.write_curve_text(trained.curve, f"{path}/curve-text")
    back = text.read_curve(spark, f"{path}/curve-text/run_id=run/grp=7", "sync").orderBy("iter").collect()
    expected = [r.best_fitness for r in trained.curve.where("grp = 7").orderBy("iter").collect()]
    assert [r.best_fitness for r in back] == pytest.approx(expected, abs=1e-15)
    assert [r.iter for r in back] == [0, 1, 2]

    for run in ("a", "b"):
        sinks.write_predictions(scored.withColumn("run_id", F.lit(run)), f"{path}/predictions", ["run_id", "grp"])
    stored = spark.read.parquet(f"{path}/predictions")
    assert stored.count() == 2 * table.count() and "run_ts" in stored.columns
    assert metrics.macro_mse(stored, ["grp"], by=["run_id"]).count() == 2

    sinks.write_prediction_report(scored, f"{path}/report")
    files = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    lines = [line for p in files for line in p.read_text().splitlines()]
    assert lines[0][:2] == "20" and lines.pop(0)[10] == " "  # the time of the run
    assert lines[0] == "05:00" and lines[8 * 6 + 1] == "06:00" and len(lines) == 18 + table.count()
    head = scored.where("grp = 5").orderBy("row_id").first()
    assert lines[1] == f"{head.real:.16f} {head.predicted:.16f}" or lines[1].split(" ")[0].startswith(f"{head.real:.6f}")

    for _ in range(2):
        sinks.write_weights(trained.weights, f"{path}/weights")
        sinks.write_weights_text(trained.weights.select("grp", "pos"), f"{path}/weights-text")
        sinks.write_runs(trained.runs, f"{path}/runs")
        sinks.write_runs_text(trained.runs, f"{path}/runs-text")
    assert spark.read.parquet(f"{path}/weights").count() == 36
    cells = text.read_cells(spark, f"{path}/weights-text")
    assert cells.count() == 36 and cells.select(F.size("cells")).distinct().first()[0] == 390
    line = spark.read.text(f"{path}/runs-text/metric=train_seconds").first().value
    assert line.startswith(f"3, 6, {table.count()}, ")


def test_cells_keep_every_line(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("a, b ,c\n1,2\n\n")
    cells = [r.cells for r in text.read_cells(spark, str(tmp_path / "cells.csv")).collect()]
    assert ["a", "b", "c"] in cells and ["1", "2"] in cells and len(cells) == 3


@pytest.fixture(scope="module")
def smoker_file(tmp_path_factory):
    rng = random.Random(2)
    lines = [",".join(SMOKER_COLUMNS)]
    for _ in range(400):
        x = [rng.gauss(0, 1) for _ in range(68)]
        lines.append(",".join(f"{v:.5f}" for v in x) + f",{int(x[0] + x[1] > 0)}")
    path = tmp_path_factory.mktemp("smoker") / "train.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_smoker_from_file_to_error_rates(spark, smoker_file, tmp_path):
    raw = text.read_delimited(spark, smoker_file, SMOKER_COLUMNS)
    table = labelled_table(raw).cache()
    network = Network("relu", "sigmoid", n_hidden=5)
    settings = SwarmSettings(particles=20, iterations=12, c1=3.5, c2=1.8, v_max=0.1, pos_max=1.0, init_range=1.0)
    trained = fit(table, ["grp"], network, "bce", settings)
    error = evaluate(table, trained.weights, ["grp"], "error", 68, network).first().error
    limited = evaluate(table, trained.weights, ["grp"], "error", 68, network, limit=100).first().error
    assert 0 < error < 0.5 and 0 <= limited <= 1
    scored = predict(table, trained.weights, ["grp"], network, 68, decide_at=0.5).cache()
    wrong = scored.where("real <> predicted").count()
    assert error == pytest.approx(wrong / 400)
    report = metrics.summary(scored, 68, 5).first()
    assert report.n_rows == 400 and report.error == pytest.approx(error)
    sinks.write_class_results(scored, f"{tmp_path}/results")
    sinks.write_class_results(scored, f"{tmp_path}/results")
    lines = spark.read.text(f"{tmp_path}/results")
    assert lines.count() == 800 and lines.first().value in ("0.0,0.0", "0.0,1.0", "1.0,0.0", "1.0,1.0")
    for metric in ("f1", "auc", "bce", "accuracy"):
        assert evaluate(table, trained.weights, ["grp"], metric, 68, network).count() == 1
    literal = evaluate(table, trained.weights, ["grp"], "auc", 68, network, mode="literal").first()
    assert literal.auc == pytest.approx(1 / (2 * literal.negatives))
    positives = scored.where("real = 1").count()
    signum = evaluate(table, trained.weights, ["grp"], "f1", 68, network, decision="signum").first().f1
    assert 1 - signum == pytest.approx((400 - positives) / (2 * positives + 400 - positives))
    flat = evaluate(table, trained.weights, ["grp"], "auc", 68, network, decision="signum").first().auc
    assert flat == 0.5


def test_wrong_weight_length_stops(spark, smoker_file):
    table = labelled_table(text.read_delimited(spark, smoker_file, SMOKER_COLUMNS))
    weights = spark.createDataFrame([(0, [0.1] * 10)], "grp int, pos array<double>")
    with pytest.raises(PySparkException):
        predict(table, weights, ["grp"], CLASSIFIER, 68).collect()


def test_rows_follow_the_files_by_name_whatever_their_size(spark, tmp_path):
    (tmp_path / "part-a.csv").write_text("h,i\n" + "".join(f"a{k},\"x\n" for k in range(3)))
    (tmp_path / "part-b.csv").write_text("h,i\n" + "".join(f"b{k},y\"\n" for k in range(30_000)))
    rows = text.read_delimited(spark, str(tmp_path), ["c", "d"]).orderBy("row_id").limit(6).collect()
    assert [tuple(r)[:2] for r in rows] == [("a0", '"x'), ("a1", '"x'), ("a2", '"x'), ("b0", 'y"'), ("b1", 'y"'), ("b2", 'y"')]


def test_every_comma_parts_cells_and_surplus_cells_are_noticed(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('h,i\n1,"x,y"\n2\n')
    with pytest.raises(PySparkException, match="more cells"):
        text.read_delimited(spark, str(path), ["c", "d"]).collect()
    got = text.read_delimited(spark, str(path), ["c", "d"], surplus="ignore").orderBy("row_id").collect()
    assert [tuple(r)[:2] for r in got] == [("1", '"x'), ("2", None)]


def test_hours_are_those_of_the_text(spark):
    raw = spark.createDataFrame([(0, "k", "1.0", "k", "2.0", "2021-03-28 02:30")], ["row_id", *DEMAND_COLUMNS])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        row = demand_table(raw).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.grp == 2 and row.x[:13] == [0.0] * 6 + [1.0] + [0.0] * 3 + [1.0] + [0.0] * 2


def test_health_table_leaves_blank_rows_out(spark):
    schema = "row_id long, left string, right string, caries string, a string, b string, smoker string"
    rows = [(1, " ", "1", "Y", "1", "2", "1"), (2, "2", "1", "N", "1", "2", "0"), (3, "2", "1", "Y", "", "2", "0")]
    table = health_table(spark.createDataFrame(rows, schema), "smoker", ("left", "right"), "caries", ["a"], ["b"])
    assert [(r.row_id, r.x) for r in table.collect()] == [(2, [1.0, 1.0, 1.0, 1.0, 2.0])]


def test_health_table(spark):
    rows = [(i, "1" if i % 3 else "2", "1", "Y" if i % 2 else "N", float(i), float(10 * i), str(i % 2)) for i in range(1, 5)]
    raw = spark.createDataFrame(rows, "row_id long, left string, right string, caries string, a double, b double, smoker string")
    table = health_table(raw, "smoker", ("left", "right"), "caries", ["a"], ["b"]).orderBy("row_id").collect()
    assert table[0].x == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 10.0] and table[0].y == 1.0
    assert table[2].x == [0.0, 1.0, 1.0, 1.0, 0.0, 3.0, 30.0]


def test_scratch_reads_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark) == configured
    scratch = Scratch(spark)
    assert scratch.folder.startswith(scratch_root(spark))
    assert scratch.store(spark.range(5), "t").count() == 5
    assert scratch.store(spark.range(3), "t").count() == 3


def test_scratch_without_setting():
    def session(master):
        context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None)
        return SimpleNamespace(conf={}, sparkContext=context)

    folder = scratch_root(session("local[2]"))
    assert folder == scratch_root(session("local[2]"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(session("spark://host:7077"))


def test_features_work_on_a_stream(spark, sf_dir):
    """Feature and forward expressions are stateless, so a stream gives what the batch gives."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(sf_dir + "/events.parquet*")
    x = calendar_features(F.col("ts"), F.get_json_object("props", "$.k").cast("double"))
    query = stream.select("event_id", x.alias("x")).writeStream.format("memory").queryName("features").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, ((r.event_id, tuple(r.x)) for r in spark.table("features").collect()))) == sorted(
        (r.event_id, tuple(r.x)) for r in batch.select("event_id", x.alias("x")).collect()
    )
