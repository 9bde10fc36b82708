"""Packing, the two fitness forms, both update orders, skew, sweeps and the properties of a training."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from murmuration import Network, SwarmSettings, evaluate, fit, sweep
from murmuration.functions.draws import lattice
from murmuration.functions.forward import forward
from murmuration.network import CLASSIFIER, REGRESSOR
from murmuration.operators.blocks import PackedTable, _packer, cluster_rows, pack_blocks
from murmuration.operators import fitness as fitness_module
from murmuration.operators.clean import _tie, first_rows
from murmuration.operators.fitness import chunk_fitness, fitness
from murmuration.operators.kernels import loss_parts, network_outputs
from murmuration.operators.packed_swarm import PackedGeneration, pack_swarm
from murmuration.operators.score import predict
from murmuration.operators.swarm import attach_best, global_best, init_swarm, move, update_personal
from murmuration.sources.scratch import Scratch
from murmuration.plans.sweep import compare_curves, stack_curves
from murmuration.plans.train import Generation, with_leaders

NET = Network(hidden="tanh", output="linear", n_hidden=3)


@pytest.fixture(scope="module")
def rows(spark):
    """Nine hundred rows of three inputs; group 0 holds two thirds of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = np.tanh(x @ np.array([1.0, -2.0, 0.5])) + rng.normal(scale=0.05, size=900)
    g = np.where(np.arange(900) < 600, 0, 1 + np.arange(900) % 3)
    table = [(int(i), int(g[i]), x[i].tolist(), float(y[i])) for i in range(900)]
    return spark.createDataFrame(table, "row_id long, grp int, x array<double>, y double").repartition(5).cache()


def arrays(rows, group):
    found = rows.where(F.col("grp") == group).orderBy("row_id").collect()
    return np.array([r.x for r in found]), np.array([r.y for r in found])


# ---- packing -----------------------------------------------------------------------------------


def test_packing_keeps_every_row(rows):
    for source in (rows, cluster_rows(rows, ["grp"], "row_id")):
        blocks = pack_blocks(source, ["grp"], row_id="row_id", rows=64).collect()
        assert max(b.n for b in blocks) <= 64 and len({b.block for b in blocks}) == len(blocks)
        ids = np.concatenate([np.frombuffer(b.bid, dtype=np.int64) for b in blocks])
        assert sorted(ids) == list(range(900))
        by_id = {r.row_id: r for r in rows.collect()}
        for b in blocks:
            x = np.frombuffer(b.bx).reshape(b.n, b.d)
            for i, row_id in enumerate(np.frombuffer(b.bid, dtype=np.int64)):
                assert by_id[row_id].grp == b.grp and x[i].tolist() == by_id[row_id].x


@pytest.mark.parametrize("bad", [
    [(0, [1.0, 2.0], 1.0), (0, [1.0], 1.0)], [(0, None, 1.0)], [(0, [1.0, None], 1.0)], [(0, [1.0], None)],
])
def test_packing_rejects(spark, bad):
    df = spark.createDataFrame(bad, "grp int, x array<double>, y double").coalesce(1)
    with pytest.raises(PySparkException):
        pack_blocks(df, ["grp"]).collect()


def test_empty_table_and_uneven_partitions(spark):
    empty = spark.createDataFrame([], "grp int, x array<double>, y double")
    with pytest.raises(ValueError, match="empty"):
        PackedTable(pack_blocks(empty, ["grp"]), ["grp"])
    two = spark.createDataFrame([(0, [1.0], 1.0)], "grp int, x array<double>, y double").union(
        spark.createDataFrame([(0, [1.0, 2.0], 1.0)], "grp int, x array<double>, y double"))
    with pytest.raises(ValueError, match="width"):
        PackedTable(pack_blocks(two, ["grp"]), ["grp"])


# ---- fitness -----------------------------------------------------------------------------------


def swarm_of(rows, n=7):
    """A stored swarm, as training keeps it.  (Spark 4.1 may infer a broken filter when a cached table is
    joined with columns computed by lambdas from its own keys.)"""
    swarm = init_swarm(rows.select("grp").distinct(), ["grp"], n, NET.n_weights(3), 1.0)
    return Scratch(rows.sparkSession).store(swarm, "swarm")


def test_both_fitness_forms_agree(rows):
    swarm = swarm_of(rows)
    kernel = {(r.grp, r.pid): r.fit for r in fitness(
        pack_blocks(rows, ["grp"], rows=50), swarm, ["grp"], ["grp"], NET, 3, "mse", 1).collect()}
    met = rows.join(swarm.select("grp", "pid", "pos"), "grp")
    error = F.pow(F.col("y") - forward(F.col("x"), F.col("pos"), 3, NET), 2)
    plain = {(r.grp, r.pid): r.fit for r in met.groupBy("grp", "pid").agg(F.avg(error).alias("fit")).collect()}
    assert kernel.keys() == plain.keys() and len(kernel) == 28
    for key, value in plain.items():
        assert kernel[key] == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("loss", ["mse", "error", "bce", "f1", "auc"])
def test_sharded_join_equals_broadcast(rows, loss):
    net = Network(hidden="relu", output="sigmoid", n_hidden=3)
    labelled = rows.withColumn("y", (F.col("y") > 0).cast("double"))
    swarm = swarm_of(labelled)
    table = PackedTable(pack_blocks(labelled, ["grp"], rows=10), ["grp"])
    plain = fitness(table.blocks, swarm, ["grp"], ["grp"], net, 3, loss, 1).collect()
    table.partition_for_joins()
    assert table.hot.where("grp = 0").first().shards > 1
    split = fitness(table.blocks, swarm, ["grp"], ["grp"], net, 3, loss, 2, table.hot, broadcast_bytes=1).collect()
    table.close()
    a, b = ({(r.grp, r.pid): r.fit for r in c} for c in (plain, split))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-12)


def test_sharded_prediction_equals_broadcast(rows):
    weights = swarm_of(rows, 1).where("grp <> 2")
    plain = predict(rows, weights, ["grp"], NET, 3)
    split = predict(rows, weights, ["grp"], NET, 3, broadcast_bytes=0)
    a, b = ({r.row_id: r.predicted for r in df.collect()} for df in (plain, split))
    assert a == b and len(a) == 900
    nulls = {r.row_id for r in rows.where("grp = 2").collect()}
    assert {k for k, v in a.items() if v is None} == nulls  # a group without a model keeps its rows


# ---- swarm steps -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiny_swarm(spark):
    table = [
        (0, 0, [0.0, 0.0], [1.0, -1.0], [0.0, 0.0], 5.0, 4.0),
        (0, 1, [1.0, 1.0], [0.5, 0.5], [2.0, 2.0], 3.0, 9.0),
        (0, 2, [4.0, 4.0], [9.0, 9.0], [3.0, 3.0], 4.0, 4.0),
    ]
    return spark.createDataFrame(
        table, "grp int, pid long, pos array<double>, vel array<double>, pbest array<double>, pbest_fit double, fit double"
    )


def test_personal_best_is_strict(tiny_swarm):
    after = {r.pid: r for r in update_personal(tiny_swarm).collect()}
    assert (after[0].pbest, after[0].pbest_fit) == ([0.0, 0.0], 4.0)
    assert (after[1].pbest, after[1].pbest_fit) == ([2.0, 2.0], 3.0)
    assert (after[2].pbest, after[2].pbest_fit) == ([3.0, 3.0], 4.0)  # equal does not replace


def test_best_and_running_best(tiny_swarm):
    best = global_best(tiny_swarm, ["grp"]).first()
    assert best.pos == [2.0, 2.0] and best.fit == 3.0
    running = attach_best(tiny_swarm, ["grp"], running=True).orderBy("pid").collect()
    assert [r.gbest_fit for r in running] == [5.0, 3.0, 3.0]
    assert [r.gbest for r in running] == [[0.0, 0.0], [2.0, 2.0], [2.0, 2.0]]


def test_lowest_particle_wins_ties(spark):
    tie = spark.createDataFrame([(0, 2, [2.0], 1.0), (0, 1, [1.0], 1.0)], "grp int, pid long, pbest array<double>, pbest_fit double")
    assert global_best(tie, ["grp"]).first().pos == [1.0]


def test_limits_hold(tiny_swarm):
    led = attach_best(tiny_swarm, ["grp"], running=False)
    after = move(led, ["grp"], 1, 1.0, 0.8, 0.2, 0.48, 0.8, draw=lattice).collect()
    assert all(abs(v) <= 0.48 for r in after for v in r.vel)
    assert all(abs(p) <= 0.8 for r in after for p in r.pos)
    free = {r.pid: r for r in move(led, ["grp"], 1, 1.0, 0.8, 0.2, 10.0, draw=lattice).collect()}
    assert free[0].pos == [p + v for p, v in zip([0.0, 0.0], free[0].vel)]


def test_personal_mode_ignores_the_global_best(tiny_swarm):
    led = attach_best(tiny_swarm, ["grp"], running=False)
    other = led.withColumn("gbest", F.array(F.lit(99.0), F.lit(99.0)))
    runs = [{r.pid: r.pos for r in move(d, ["grp"], 1, 1.0, 0.8, 0.2, 10.0, social="personal").collect()} for d in (led, other)]
    assert runs[0] == runs[1]
    runs = [{r.pid: r.pos for r in move(d, ["grp"], 1, 1.0, 0.8, 0.2, 10.0).collect()} for d in (led, other)]
    assert runs[0] != runs[1]


# ---- whole trainings ---------------------------------------------------------------------------


def lattice_number(p, k, g, t):
    mixed = p * 7919 + k * 104729 + g * 15485863 + t * 32452843
    return ((mixed * 48271) % 2147483647) / 2147483647.0


def loop_training(x, y, group, settings, per_particle):
    """The same training written as nested loops over generations and particles."""
    size = NET.n_weights(3)
    a = settings.init_range
    m = settings.particles
    pos = [np.array([a * (2 * lattice_number(p, k, group, 0) - 1) for k in range(size)]) for p in range(m)]
    vel = [np.array([a * (2 * lattice_number(p, k + size, group, 0) - 1) for k in range(size)]) for p in range(m)]

    def loss(w):
        hidden = np.tanh(x @ w[:9].reshape(3, 3).T)
        return np.mean((y - hidden @ w[9:]) ** 2)

    own, own_fit = [p.copy() for p in pos], [loss(p) for p in pos]
    first = int(np.argmin(own_fit))
    best, best_fit, curve = own[first].copy(), own_fit[first], []

    def step(p, t):
        r1, r2 = lattice_number(p, 0, group, t), lattice_number(p, 1, group, t)
        v = settings.inertia * vel[p] + settings.c1 * r1 * (own[p] - pos[p]) + settings.c2 * r2 * (best - pos[p])
        vel[p] = np.clip(v, -settings.v_max, settings.v_max)
        pos[p] = pos[p] + vel[p]
        if settings.pos_max is not None:
            pos[p] = np.clip(pos[p], -settings.pos_max, settings.pos_max)

    for t in range(1, settings.iterations + 1):
        for p in range(m):
            value = loss(pos[p])
            if value < own_fit[p]:
                own[p], own_fit[p] = pos[p].copy(), value
            if own_fit[p] < best_fit:
                best, best_fit = own[p].copy(), own_fit[p]
            if per_particle:
                step(p, t)
        if not per_particle:
            for p in range(m):
                step(p, t)
        curve.append(best_fit)
    return best, curve


@pytest.mark.parametrize("update", ["sync", "async"])
def test_training_equals_nested_loops(rows, update):
    settings = SwarmSettings(particles=9, iterations=6, v_max=0.5, pos_max=2.0, init_range=1.5, update=update)
    trained = fit(rows, ["grp"], NET, "mse", settings, draw=lattice)
    weights = {r.grp: r for r in trained.weights.collect()}
    curves = trained.curve.collect()
    for group in range(4):
        best, curve = loop_training(*arrays(rows, group), group, settings, update == "async")
        mine = [r.best_fitness for r in sorted(curves, key=lambda r: r.iter) if r.grp == group]
        assert mine == pytest.approx(curve, rel=1e-9)
        assert weights[group].pos == pytest.approx(best.tolist(), rel=1e-9)
        assert weights[group].fit == mine[-1]


def test_training_does_not_depend_on_partitions(rows):
    settings = SwarmSettings(particles=6, iterations=3, v_max=1.0, init_range=2.0)
    runs = [fit(df, ["grp"], NET, "mse", settings) for df in (rows, rows.repartition(2), rows.repartition(9, "grp"))]
    runs.append(fit(rows, ["grp"], NET, "mse", settings, broadcast_bytes=0))
    found = [{r.grp: r.pos for r in t.weights.collect()} for t in runs]
    assert found[0] == found[1] == found[2] == found[3]


@pytest.mark.parametrize("update", ["sync", "async"])
def test_generations_move_no_whole_particles(rows, update):
    """Windows carry who is best, exchanges carry narrow rows or the few record holders."""
    advance = Generation(["grp"], SwarmSettings(update=update))
    state = Scratch(rows.sparkSession).store(with_leaders(swarm_of(rows)), "state")
    fits = Scratch(rows.sparkSession).store(state.select("grp", "pid", F.lit(1.0).alias("fit")), "fits")
    plan = advance(state, fits, False)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line or "Exchange hashpartitioning" in line:
            assert not any(f"{c}#" in line for c in ("pos", "vel", "pbest"))
    assert "Exchange hashpartitioning(grp" in plan


def test_null_groups_and_features_that_are_no_numbers_stop(spark):
    schema = "row_id long, grp int, x array<double>, y double"
    with pytest.raises(ValueError, match="null group"):
        fit(spark.createDataFrame([(0, None, [1.0], 1.0), (1, 1, [1.0], 1.0)], schema), ["grp"], particles=2, iterations=1)
    with pytest.raises(PySparkException, match="NaN"):
        fit(spark.createDataFrame([(0, 1, [float("nan")], 1.0)], schema), ["grp"], particles=2, iterations=1)


@pytest.mark.parametrize("loss", ["mse", "auc"])
def test_blocks_travel_without_particles(rows, loss):
    """A swarm within the limit is in the tasks: Python is sent the packed rows and nothing beside them."""
    classes = rows.withColumns({"tier": F.lit(0), "y": (F.col("y") > 0).cast("double")})
    table = PackedTable(pack_blocks(classes, ["grp", "tier"]), ["grp", "tier"])
    start = init_swarm(rows.select("grp").distinct(), ["grp"], 7, 12, 1.0).withColumns({"iters": F.lit(1), "tier": F.lit(0)})
    chunks = PackedGeneration(["grp"], SwarmSettings()).moved(pack_swarm(start, ["grp"], 12), 1)
    for limit in (1 << 20, 0):
        fits, shared = chunk_fitness(table.blocks, chunks, ["grp", "tier"], ["grp"], NET, 3, loss, 8 * 12 * 28, broadcast_bytes=limit)
        plan = fits._jdf.queryExecution().analyzed().toString()
        assert ("flat" in plan) == (limit == 0) and (shared is None) == (limit == 0)
        found = {(r.grp, p.pid): p.fit for r in fits.collect() for p in r.fits}
        plain = fitness(table.blocks, start, ["grp", "tier"], ["grp"], NET, 3, loss).collect()
        assert found == {(r.grp, r.pid): pytest.approx(r.fit, rel=1e-12) for r in plain}
    table.close()


@pytest.mark.parametrize("update", ["sync", "async"])
def test_groups_of_several_chunks(rows, update, monkeypatch):
    """Two particles a chunk: the best before a chunk comes from the chunks before it."""
    settings = SwarmSettings(particles=9, iterations=5, v_max=0.5, pos_max=2.0, init_range=1.5, update=update)
    whole = fit(rows, ["grp"], NET, "mse", settings, draw=lattice)
    monkeypatch.setattr(fitness_module, "CHUNK_BYTES", 8 * 12 * 2)
    for limit in (1 << 20, 0):
        parts = fit(rows, ["grp"], NET, "mse", settings, draw=lattice, broadcast_bytes=limit)
        assert {r.grp: r.pos for r in parts.weights.collect()} == {r.grp: r.pos for r in whole.weights.collect()}
        curves = [{(r.grp, r.iter): r.best_fitness for r in t.curve.collect()} for t in (parts, whole)]
        assert curves[0] == pytest.approx(curves[1], rel=1e-12)


def test_stored_tables_can_be_dropped(rows):
    import os

    trained = fit(rows, ["grp"], NET, "mse", particles=3, iterations=2)
    assert {t for t in os.listdir(trained.scratch.folder) if not t.startswith(".")} == {"leaders"}
    errors = {r.metric: r.value for r in trained.runs.collect()}
    assert errors["train_mse"] == pytest.approx(trained.weights.agg(F.avg("fit")).first()[0]) and errors["train_seconds"] > 0
    trained.close()
    assert not os.path.exists(trained.scratch.folder)


@pytest.mark.parametrize("broadcast_bytes", [10**9, 0])
def test_scoring_without_targets(rows, broadcast_bytes):
    model = swarm_of(rows, 1).where("grp < 3").select("grp", "pos")
    named = rows.select(F.concat(F.lit("r"), "row_id").alias("name"), "grp", "x", F.col("y").alias("extra")).unionByName(
        rows.sparkSession.createDataFrame([("null", 0, None, 1.0), ("no group", None, [1.0, 1.0, 1.0], 1.0)],
                                          "name string, grp int, x array<double>, extra double"))
    got = predict(named, model, ["grp"], NET, 3, y=None, row_id="name", keep=["extra"], broadcast_bytes=broadcast_bytes)
    assert got.columns == ["grp", "row_id", "extra", "predicted"]
    found = {r.row_id: r for r in got.collect()}
    real = {r.row_id: r.predicted for r in predict(rows, model, ["grp"], NET, 3).collect()}
    assert len(found) == 902 and found["null"].predicted is None and found["no group"].predicted is None
    assert all(found[f"r{k}"].predicted == p for k, p in real.items())
    assert sum(p is None for p in real.values()) == rows.where("grp = 3").count()


def test_curves_never_rise_and_training_helps(rows):
    settings = SwarmSettings(particles=20, iterations=15, v_max=0.5, pos_max=3.0, init_range=1.0, update="async")
    trained = fit(rows, ["grp"], NET, "mse", settings)
    for group in range(4):
        curve = [r.best_fitness for r in trained.curve.where(F.col("grp") == group).orderBy("iter").collect()]
        assert len(curve) == 15 and curve == sorted(curve, reverse=True)
        assert curve[-1] < 0.5 * np.var(arrays(rows, group)[1])
    record = trained.runs.where("metric = 'train_seconds'").first()
    assert (record.iters, record.parts, record.rows) == (15, 20, 900) and record.value > 0
    mse = evaluate(rows, trained.weights.drop("run_id"), ["grp"], "mse", 3, NET, by_group=True).collect()
    fits = {r.grp: r.fit for r in trained.weights.collect()}
    for r in mse:
        assert r.mse == pytest.approx(fits[r.grp], rel=1e-9)


def test_text_and_several_group_columns(rows):
    named = rows.select("row_id", F.concat(F.lit("g"), F.col("grp")).alias("name"), (F.col("grp") % 2).alias("odd"), "x", "y")
    trained = fit(named, ["name", "odd"], NET, "mse", particles=4, iterations=2)
    assert {(r.name, r.odd) for r in trained.weights.collect()} == {("g0", 0), ("g1", 1), ("g2", 0), ("g3", 1)}


def test_undefined_loss_keeps_the_start(rows):
    positives = rows.withColumn("y", F.lit(1.0))
    trained = fit(positives, ["grp"], CLASSIFIER, "auc", particles=3, iterations=2)
    weights = trained.weights.collect()
    assert len(weights) == 4 and all(r.fit == float("inf") and r.pos is not None for r in weights)


def test_wrong_arguments(rows):
    with pytest.raises(ValueError):
        fit(rows, ["grp"], NET, "hinge", particles=2, iterations=1)
    with pytest.raises(ValueError):
        SwarmSettings(update="sometimes")
    with pytest.raises(ValueError):
        SwarmSettings(social="none")
    with pytest.raises(ValueError):
        Network(hidden="cosine")


# ---- sweeps ------------------------------------------------------------------------------------


def test_sweep_equals_single_trainings(rows):
    settings = SwarmSettings(v_max=0.5, init_range=1.0)
    swept = sweep(rows, ["grp"], [300, 700, None], [2, 4], [3, 5], NET, "mse", settings)
    weights = {(r.run_id, r.grp): r for r in swept.weights.collect()}
    assert len(swept.runs.collect()) == 24
    for n in (300, 700, None):
        part = rows if n is None else rows.where(F.col("row_id") < n)
        for iterations, particles in ((2, 5), (4, 3)):
            alone = fit(part, ["grp"], NET, "mse", settings, iterations=iterations, particles=particles)
            for r in alone.weights.collect():
                mine = weights[(f"rows={n or 'all'},iters={iterations},parts={particles}", r.grp)]
                assert mine.fit == pytest.approx(r.fit, rel=1e-9) and mine.pos == pytest.approx(r.pos, rel=1e-9)
    lengths = swept.curve.groupBy("run_id", "grp").count().collect()
    assert all(r["count"] == int(r.run_id.split("iters=")[1][0]) for r in lengths)


def test_sweep_limits_end_among_equal_rows(spark):
    same = [(5, 0, [1.0, 2.0, 3.0], 4.0)] * 6
    rows = spark.createDataFrame([(1, 0, [0.5, 0.5, 0.5], 1.0), *same, (9, 0, [3.0, 1.0, 2.0], 2.0)],
                                 "row_id int, grp int, x array<double>, y double").repartition(3).cache()
    limits = [2, 4, 7, None]
    swept = sweep(rows, ["grp"], limits, [2], [3], NET, "mse", SwarmSettings(v_max=0.5, init_range=1.0))
    fits = {r.run_id: r.fit for r in swept.weights.collect()}
    for n in limits:
        part = rows if n is None else first_rows(rows, n)
        assert part.count() == (n or 8)
        alone = fit(part, ["grp"], NET, "mse", SwarmSettings(v_max=0.5, init_range=1.0), iterations=2, particles=3)
        assert fits[f"rows={n or 'all'},iters=2,parts=3"] == pytest.approx(alone.weights.first().fit, rel=1e-9)


def test_nulls_in_different_cells_are_different_rows(spark):
    rows = spark.createDataFrame([(1, None, 7), (1, 7, None)] * 4, "row_id int, a int, b int")
    assert rows.select(_tie(rows)).distinct().count() == 2
    assert first_rows(rows, 4).distinct().count() == 1 and first_rows(rows, 3).count() == 3


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_null_groups_have_no_model(spark, broadcast_bytes):
    rows = spark.createDataFrame([(1, None, [1.0]), (2, 3, [1.0])], "row_id int, grp int, x array<double>")
    weights = spark.createDataFrame([(None, [2.0, 3.0]), (3, [2.0, 3.0])], "grp int, pos array<double>")
    net = Network(hidden="identity", output="linear", n_hidden=1)
    found = predict(rows, weights, ["grp"], net, 1, y=None, broadcast_bytes=broadcast_bytes)
    assert {r.row_id: r.predicted for r in found.collect()} == {1: None, 2: 6.0}


def test_curve_comparison(spark):
    a = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 3.0)], "iter int, best_fitness double")
    b = spark.createDataFrame([(0, 9.0), (1, 8.0)], "iter int, best_fitness double")
    got = {r.algo: r for r in compare_curves(stack_curves({"a": a, "b": b}), []).collect()}
    assert (got["a"].first_fitness, got["a"].best_fitness, got["a"].reached_at, got["a"].n_iters) == (5.0, 3.0, 1, 3)
    assert got["b"].reached_at == 1


def test_two_layer_training(rows):
    net = Network(hidden="tanh", output="linear", layers=2, n_hidden=3)
    trained = fit(rows, ["grp"], net, "mse", particles=4, iterations=2, init_range=1.0)
    assert all(len(r.pos) == net.n_weights(3) for r in trained.weights.collect())
    mse = {r.grp: r.mse for r in evaluate(rows, trained.weights, ["grp"], "mse", 3, net, by_group=True).collect()}
    for r in trained.weights.collect():
        assert mse[r.grp] == pytest.approx(r.fit, rel=1e-9)
    assert REGRESSOR.layers == 1


def test_packing_sends_its_rows_in_parts(monkeypatch):
    """A task lets go of its waiting rows a few blocks at a time, with no second copy of all of them."""
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))

    def source():
        for start in range(0, 200_000, 10_000):
            ids = np.arange(start, start + 10_000)
            x = pa.ListArray.from_arrays(pa.array(np.arange(10_001, dtype=np.int32) * 40), pa.array(np.repeat(ids * 1.0, 40)))
            yield pa.RecordBatch.from_pydict({"grp": pa.array(ids % 5), "x": x, "y": pa.array(ids * 1.0)})

    sizes, seen = [], []
    tracemalloc.start()
    for batch in _packer(("grp",), None, False)(source()):
        sizes.append(batch.nbytes)
        seen += [np.frombuffer(b.as_py()) for b in batch.column("by")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(np.concatenate(seen)) == list(range(200_000))
    assert max(sizes) < 16 << 20 and peak < 72 << 20  # 64 MB of rows in all


@pytest.mark.parametrize("loss", ["mse", "bce", "f1"])
def test_scores_of_a_wide_swarm_are_taken_in_slices(loss):
    rng = np.random.default_rng(1)
    net = ("tanh", "sigmoid", 1, 2)
    x, y, weights = rng.normal(size=(10_001, 3)), rng.integers(0, 2, 10_001) * 1.0, rng.normal(size=(500, 8))
    whole = loss_parts(y, network_outputs(x, weights, *net), loss)

    def meetings(batch):
        yield (1,), x, y, np.arange(500), weights

    tracemalloc.start()
    (got,) = fitness_module._summer(meetings, [pa.int32()], net, loss, "threshold")(iter([None]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("n").to_pylist() == [10_001] * 500
    assert np.allclose(np.column_stack([got.column(f"s{j}") for j in range(3)]), whole)
    assert peak < 64 << 20  # all scores are 40 MB, and a loss needs them several times


def test_auc_scores_are_sent_in_slices():
    rng = np.random.default_rng(1)
    net = ("tanh", "sigmoid", 1, 2)
    x, y, weights = rng.normal(size=(3_000, 3)), rng.integers(0, 2, 3_000) * 1.0, rng.normal(size=(800, 8))
    sent = list(fitness_module._scorer(lambda batch: [((1,), x, y, np.arange(800), weights)], [pa.int32()], net)(iter([None])))
    assert max(b.num_rows for b in sent) <= 1 << 20
    assert sorted(set(np.concatenate([b.column("pid") for b in sent]))) == list(range(800))
    assert sum(sum(b.column("positives").to_pylist()) for b in sent) == 800 * y.sum()
    assert sum(sum(b.column("negatives").to_pylist()) for b in sent) == 800 * (len(y) - y.sum())
