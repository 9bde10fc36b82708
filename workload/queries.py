"""One query per operator; every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import calendar, scalar, vectors as vec
from murmuration.functions.draws import drawn_vector, lattice
from murmuration.functions.forward import forward
from murmuration.network import CLASSIFIER, DEEP_CLASSIFIER, LINEAR_REGRESSOR, REGRESSOR, Network
from murmuration.operators import clean, encode, metrics, wide
from murmuration.operators.blocks import pack_blocks
from murmuration.operators.fitness import fitness
from murmuration.operators.score import predict
from murmuration.operators.swarm import (
    LEADER,
    attach_best,
    global_best,
    init_swarm,
    move,
    update_personal,
)
from murmuration.plans.evaluate import error_report, evaluate
from murmuration.plans.sweep import compare_curves, monotone_curve, stack_curves, sweep
from murmuration.plans.train import Generation, SwarmSettings, fit, with_leaders
from murmuration.sources import sinks, text
from murmuration.sources.scratch import Scratch
from workload.bindings import (
    DEMAND_INPUTS,
    VECTOR_INPUTS,
    demand,
    lattice_weights,
    mixed,
    stored_pairs,
    table,
    vectors,
)

Query = Callable[[SparkSession, str], DataFrame]

# Small networks and swarms for the queries that SQL repeats step by step.
SMALL = Network(hidden="tanh", output="linear", n_hidden=3)
SMALL_LINEAR = Network(hidden="identity", output="linear", n_hidden=3)
SMALL_WEIGHTS = SMALL.n_weights(DEMAND_INPUTS)
PARTICLES = 6
ITERATIONS = 4
FREE = SwarmSettings(particles=PARTICLES, iterations=ITERATIONS, v_max=0.5, init_range=1.0)
BOUNDED = SwarmSettings(particles=PARTICLES, iterations=ITERATIONS, v_max=0.48, pos_max=0.8, init_range=2.0,
                        update="async")
PERSONAL = SwarmSettings(particles=PARTICLES, iterations=ITERATIONS, v_max=0.48, pos_max=0.8, init_range=2.0,
                         update="async", social="personal")
CLASS_SWARM = SwarmSettings(particles=PARTICLES, iterations=ITERATIONS, c1=3.5, c2=1.8, v_max=0.1, pos_max=1.0,
                            init_range=1.0)
PUBLISHED = SwarmSettings(particles=4, iterations=2)  # the published constants and width, few particles and generations
SMALL_CLASSIFIER = Network(hidden="relu", output="sigmoid", n_hidden=4)
SWEEP_ROWS = [5000, None]
SWEEP_ITERATIONS = [2, 3]
SWEEP_PARTICLES = [4, 6]


def r6(column: Column) -> Column:
    """Six decimals; sums differ in their last digits with the order of the partitions."""
    return F.round(column, 6) + F.lit(0.0)


def spelled(df: DataFrame, keys: list[str], arrays: dict[str, str], rounded: bool = True) -> DataFrame:
    """One row per array position: ``*keys, k`` and one column per array."""
    names = list(arrays)
    long = df.select(
        *keys, F.posexplode(F.arrays_zip(*[F.col(arrays[n]).alias(n) for n in names])).alias("k", "e")
    )
    return long.select(*keys, F.col("k").cast("long").alias("k"),
                       *[(r6(F.col(f"e.{n}")) if rounded else F.col(f"e.{n}")).alias(n) for n in names])


# ---- cleaning, labels, calendar ----------------------------------------------------------------


def clean_limit(spark, sf_dir):
    """The first 500 complete rows, in key order, of a text table with some blank cells."""
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    kept = clean.first_rows(clean.complete_rows(raw, ["balance", "segment"]), 500)
    return kept.select("row_id", F.col("balance").cast("double").alias("balance"))


def limit_large(spark, sf_dir):
    """The first third of all order lines by ship date: unknown dates come first, dates repeat, the limit is large."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "A", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
    )
    first = clean.first_rows(lines, lines.count() // 3, "day")
    return first.groupBy("day").agg(F.count("*").alias("n_rows"))


def leading_columns(spark, sf_dir):
    """The first three columns as features, the fourth as label."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    x, label = clean.leading_features(lines, 3)
    return spelled(lines.select("c_custkey", label.alias("label"), x.alias("x")), ["c_custkey", "label"], {"v": "x"})


def fixed_decimals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.fixed16(F.floor("value") / F.lit(8.0)).alias("text"))


def label_decode(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", clean.decode_label(F.col("quality").cast("string")).alias("y"))


def calendar_parts(spark, sf_dir):
    stamped = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp")
    )
    day, time = calendar.day_text(F.col("stamp")), calendar.time_text(F.col("stamp"))
    hour = calendar.hour_text(time)
    return stamped.select(
        "event_id", day.alias("day"), time.alias("time"), hour.alias("hour"),
        calendar.minute_text(time).alias("minute"),
        calendar.weekday_name(F.to_date(day)).alias("weekday"),
        calendar.month_name(F.to_date(day)).alias("month"),
        calendar.hour_label(hour.cast("int")).alias("label"),
    )


# ---- vectors and encoders ----------------------------------------------------------------------


def onehot_first_seen(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    coded = events.select("event_id", encode.one_hot_first_seen(events, "event_type", "event_id").alias("x"))
    return spelled(coded, ["event_id"], {"v": "x"})


def assemble_calendar(spark, sf_dir):
    """Hour, weekday, minute slot and number in one vector; then the hour block is cut off."""
    stamp = F.col("ts")
    full = vec.append(
        F.concat(
            vec.one_hot(F.hour(stamp), range(24)),
            vec.one_hot(calendar.iso_weekday(stamp), calendar.WEEKDAYS),
            vec.one_hot(calendar.minute_slot(stamp), calendar.MINUTE_SLOTS),
        ),
        F.get_json_object("props", "$.k").cast("double") / F.lit(100.0),
    )
    wide = table(spark, sf_dir, "events").select("event_id", full.alias("all"))
    return spelled(wide.select("event_id", vec.cut(F.col("all"), 24, 14).alias("x")), ["event_id"], {"v": "x"})


def assemble_mixed(spark, sf_dir):
    wide = encode.assemble_features(
        mixed(spark, sf_dir), ["l_returnflag", "l_linestatus", "o_orderpriority"],
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], order="line",
    )
    return wide.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(14)],
    )


def dims(spark, sf_dir):
    d = clean.dimensions(vectors(spark, sf_dir))
    hidden = F.floor(F.lit(1.9) * F.col("max_width"))
    return d.select(
        "n_rows", F.col("min_width").cast("long").alias("min_width"), F.col("max_width").cast("long").alias("n_inputs"),
        "null_x", "null_y", hidden.alias("n_hidden"), (hidden * (F.col("max_width") + 1)).alias("n_weights"),
    )


def linear_predict(spark, sf_dir):
    w = drawn_vector(lattice, 0, [F.col("grp")], F.lit(0), VECTOR_INPUTS, 1.0)
    return vectors(spark, sf_dir).withColumn("w", w).select("row_id", r6(vec.dot(F.col("x"), F.col("w"))).alias("h"))


def activations(spark, sf_dir):
    v = (F.col("value") - F.lit(100.0)) / F.lit(50.0)
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select(
        "event_id",
        r6(scalar.relu(F.col("v"))).alias("relu"),
        r6(scalar.relu(F.col("v"), nan_to_zero=True)).alias("relu_if"),
        r6(scalar.sigmoid(F.col("v"))).alias("sigmoid"),
        r6(F.tanh("v")).alias("tanh"),
        scalar.threshold(F.col("v")).alias("threshold"),
        F.signum("v").alias("sign"),
        r6(scalar.clip_probability(F.col("v"))).alias("clipped"),
        r6(scalar.clamp(F.col("v"), 0.48)).alias("clamped"),
        r6(scalar.squared_error(F.col("v"), F.lit(1.0))).alias("squared_error"),
    )


# ---- forward passes ----------------------------------------------------------------------------


def _forward(data_of, network, n_inputs, limit):
    def query(spark, sf_dir):
        data = data_of(spark, sf_dir)
        scored = predict(data, lattice_weights(data, network, n_inputs, limit), ["grp"], network, n_inputs, y=None)
        return scored.select("row_id", r6(F.col("predicted")).alias("predicted"))

    return query


def _demand_scores(spark, sf_dir):
    data = demand(spark, sf_dir)
    weights = lattice_weights(data, REGRESSOR, DEMAND_INPUTS, 0.5)
    return predict(data, weights, ["grp"], REGRESSOR, DEMAND_INPUTS)


def _vector_scores(spark, sf_dir):
    data = vectors(spark, sf_dir)
    weights = lattice_weights(data, CLASSIFIER, VECTOR_INPUTS, 0.5)
    return predict(data, weights, ["grp"], CLASSIFIER, VECTOR_INPUTS, decide_at=0.5)


def hourly_predict(spark, sf_dir):
    return _demand_scores(spark, sf_dir).select("grp", "row_id", r6(F.col("real")).alias("real"),
                                                r6(F.col("predicted")).alias("predicted"))


def class_predict(spark, sf_dir):
    return _vector_scores(spark, sf_dir).select("row_id", "real", r6(F.col("score")).alias("score"), "predicted")


def predict_unlabelled(spark, sf_dir):
    """Scores of rows without targets, known by a text; one class of rows has no model."""
    data = vectors(spark, sf_dir).select(
        F.concat(F.lit("v"), F.col("row_id").cast("string")).alias("name"), "x", (F.col("row_id") % 3).cast("int").alias("grp")
    )
    weights = lattice_weights(data.where("grp < 2"), CLASSIFIER, VECTOR_INPUTS, 0.5)
    scored = predict(data, weights, ["grp"], CLASSIFIER, VECTOR_INPUTS, y=None, row_id="name")
    return scored.select("grp", F.col("row_id").alias("name"), r6(F.col("predicted")).alias("predicted"))


def evaluate_bce(spark, sf_dir):
    """Cross-entropy where a third of the rows has no model: those rows do not count."""
    data = vectors(spark, sf_dir).withColumn("grp", (F.col("row_id") % 3).cast("int"))
    weights = lattice_weights(data.where("grp < 2"), CLASSIFIER, VECTOR_INPUTS, 0.5)
    value = evaluate(data, weights, ["grp"], "bce", VECTOR_INPUTS, CLASSIFIER)
    return value.select(r6(F.col("bce")).alias("bce"))


def evaluate_limit(spark, sf_dir):
    """The error on the first 100 rows."""
    data = vectors(spark, sf_dir)
    weights = lattice_weights(data, CLASSIFIER, VECTOR_INPUTS, 0.5)
    value = evaluate(data, weights, ["grp"], "error", VECTOR_INPUTS, CLASSIFIER, limit=100)
    return value.select(r6(F.col("error")).alias("loss"))


def in_out_errors(spark, sf_dir):
    """Error rates of one model on four fifths of the rows and on the rest."""
    data = vectors(spark, sf_dir)
    weights = lattice_weights(data, CLASSIFIER, VECTOR_INPUTS, 0.5)
    inside, outside = data.where("row_id % 5 <> 0"), data.where("row_id % 5 = 0")
    report = error_report(inside, outside, weights, ["grp"], VECTOR_INPUTS)
    return report.withColumns({"error_in": r6(F.col("error_in")), "error_out": r6(F.col("error_out"))})


def report_lines(spark, sf_dir):
    """The lines of the prediction report over rounded predictions."""
    scored = _demand_scores(spark, sf_dir).select(
        "grp", "row_id", F.floor("real").cast("double").alias("real"), F.floor("predicted").cast("double").alias("predicted")
    )
    return sinks.prediction_lines(scored).select("hour", "part", F.coalesce("row_id", F.lit(-1)).alias("row_id"), "line")


def model_lines(spark, sf_dir):
    """The lines of the weight file; eighths have the same text everywhere."""
    weights = lattice_weights(demand(spark, sf_dir), SMALL, DEMAND_INPUTS, 0.5).withColumn(
        "pos", F.transform("pos", lambda w: F.floor(w * 8) / F.lit(8.0))
    )
    return sinks.weight_lines(weights)


# ---- aggregations and metrics ------------------------------------------------------------------


def rows_per_hour(spark, sf_dir):
    counts = demand(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("grp", calendar.hour_label(F.col("grp")).alias("label"), "n_rows")


def hourly_mse(spark, sf_dir):
    return metrics.mse(_demand_scores(spark, sf_dir), by=["grp"]).select("grp", r6(F.col("mse")).alias("mse"))


def macro_mse(spark, sf_dir):
    return metrics.macro_mse(_demand_scores(spark, sf_dir), ["grp"]).select(r6(F.col("macro_mse")).alias("macro_mse"))


def pair_mse(spark, sf_dir):
    pairs = demand(spark, sf_dir).select(F.col("y").alias("real"), F.element_at("x", -1).alias("predicted"))
    return metrics.mse(pairs).select(r6(F.col("mse")).alias("mse"))


def accuracy(spark, sf_dir):
    return metrics.accuracy(stored_pairs(spark, sf_dir)).select(r6(F.col("accuracy")).alias("accuracy"))


def class_counts(spark, sf_dir):
    return metrics.class_counts(stored_pairs(spark, sf_dir))


def f1(spark, sf_dir):
    return metrics.f1(stored_pairs(spark, sf_dir)).select("tp", "fp", "fn", r6(F.col("f1")).alias("f1"))


def bce(spark, sf_dir):
    return metrics.cross_entropy(_vector_scores(spark, sf_dir)).select(r6(F.col("bce")).alias("bce"))


def auc(spark, sf_dir):
    return metrics.auc(_vector_scores(spark, sf_dir)).select(
        "positives", "negatives", r6(F.col("auc")).alias("auc")
    )


def auc_hourly(spark, sf_dir):
    """AUC per hour for "value above one", scored by the hourly regressors; ties only where the ninth decimal is level."""
    scored = _demand_scores(spark, sf_dir).select(
        "grp", F.when(F.col("real") > 1.0, 1.0).otherwise(0.0).alias("real"),
        F.round("predicted", 9).alias("score"),
    )
    return metrics.auc(scored, by=["grp"]).select("grp", "positives", "negatives", r6(F.col("auc")).alias("auc"))


def auc_literal(spark, sf_dir):
    return metrics.auc(_vector_scores(spark, sf_dir), mode="literal").select(
        "positives", "negatives", F.round("auc", 9).alias("auc")
    )


def summary(spark, sf_dir):
    d, h = VECTOR_INPUTS, CLASSIFIER.width(VECTOR_INPUTS)
    return metrics.summary(_vector_scores(spark, sf_dir), d, h).select(
        "n_rows", "real_ones", "predicted_ones", r6(F.col("error")).alias("error"), "n_inputs", "n_hidden"
    )


def _loss(loss, decision="threshold"):
    """The loss of five particles on the labelled vectors, through the block kernel."""

    def query(spark, sf_dir):
        data = vectors(spark, sf_dir).withColumn("tier", F.lit(0))
        width = CLASSIFIER.n_weights(VECTOR_INPUTS)
        swarm = init_swarm(data.select("grp", "tier").distinct(), ["grp"], 5, width, 0.5, draw=lattice)
        blocks = pack_blocks(data, ["grp", "tier"])
        fits = fitness(blocks, swarm, ["grp", "tier"], ["grp"], CLASSIFIER, VECTOR_INPUTS, loss, decision=decision)
        return fits.select("grp", "pid", r6(F.col("fit")).alias("loss"))

    return query


def _evaluate(metric, **options):
    def query(spark, sf_dir):
        data = vectors(spark, sf_dir)
        weights = lattice_weights(data, CLASSIFIER, VECTOR_INPUTS, 0.5)
        value = evaluate(data, weights, ["grp"], metric, VECTOR_INPUTS, CLASSIFIER, **options)
        return value.select(r6(F.lit(1.0) - F.col(metric)).alias("loss") if metric != "error"
                            else r6(F.col(metric)).alias("loss"))

    return query


# ---- the swarm ---------------------------------------------------------------------------------


def _small_swarm(data, settings=FREE, tag=0):
    groups = data.select("grp").distinct()
    return init_swarm(groups, ["grp"], settings.particles, SMALL_WEIGHTS, settings.init_range, draw=lattice, seed=tag)


def _small_fitness(data, swarm, network=SMALL):
    blocks = pack_blocks(data, ["grp"])
    return fitness(blocks, swarm, ["grp"], ["grp"], network, DEMAND_INPUTS, "mse")


def _evaluated(spark, sf_dir):
    """A swarm whose personal bests are the starts, with new positions and their fitness in ``fit``."""
    data = demand(spark, sf_dir)
    start = _small_swarm(data)
    first = start.drop("pbest_fit").join(
        _small_fitness(data, start).withColumnRenamed("fit", "pbest_fit"), ["grp", "pid"]
    )
    moved = _small_swarm(data, tag=7).select("grp", "pid", "pos")
    return first.drop("pos").join(moved, ["grp", "pid"]).join(_small_fitness(data, moved), ["grp", "pid"])


def swarm_init(spark, sf_dir):
    return spelled(_small_swarm(demand(spark, sf_dir)), ["grp", "pid"], {"pos": "pos", "vel": "vel"})


def swarm_fitness(spark, sf_dir):
    data = demand(spark, sf_dir)
    return _small_fitness(data, _small_swarm(data)).select("grp", "pid", r6(F.col("fit")).alias("fit"))


def swarm_fitness_expression(spark, sf_dir):
    """The same fitness by a join of rows with particles and Column expressions."""
    data = demand(spark, sf_dir)
    swarm = _small_swarm(data).select("grp", "pid", "pos")
    met = data.join(F.broadcast(swarm), "grp")  # 24 hours with a few small particles each
    error = scalar.squared_error(F.col("y"), forward(F.col("x"), F.col("pos"), DEMAND_INPUTS, SMALL))
    return met.groupBy("grp", "pid").agg(r6(F.avg(error)).alias("fit"))


def swarm_pbest(spark, sf_dir):
    after = update_personal(_evaluated(spark, sf_dir))
    return spelled(after.withColumn("pbest_fit", r6(F.col("pbest_fit"))), ["grp", "pid", "pbest_fit"],
                   {"pbest": "pbest"})


def swarm_gbest(spark, sf_dir):
    best = global_best(update_personal(_evaluated(spark, sf_dir)), ["grp"])
    return spelled(best.withColumn("fit", r6(F.col("fit"))), ["grp", "fit"], {"pos": "pos"})


def swarm_gbest_running(spark, sf_dir):
    running = attach_best(update_personal(_evaluated(spark, sf_dir)), ["grp"], running=True)
    return spelled(running.withColumn("gbest_fit", r6(F.col("gbest_fit"))), ["grp", "pid", "gbest_fit"],
                   {"gbest": "gbest"})


def _move(settings):
    def query(spark, sf_dir):
        led = attach_best(update_personal(_evaluated(spark, sf_dir)), ["grp"], running=False)
        after = move(led, ["grp"], 3, settings.inertia, settings.c1, settings.c2, settings.v_max, settings.pos_max,
                     settings.social, draw=lattice)
        return spelled(after, ["grp", "pid"], {"pos": "pos", "vel": "vel"})

    return query


def _generations(settings, network):
    """Two whole generations; states and judgements are stored tables, as in a training."""

    def query(spark, sf_dir):
        data = demand(spark, sf_dir)
        advance, scratch = Generation(["grp"], settings, lattice), Scratch(spark)
        state = scratch.store(with_leaders(_small_swarm(data, settings)), "start")
        for first in (True, False):
            fits = _small_fitness(data, state.where(F.col("pid") != LEADER), network)
            after = advance(state, fits, first, lambda df: scratch.store(df, f"judged-{first}"))
            state = scratch.store(after, f"state-{first}")
        return spelled(state.where(F.col("pid") != LEADER).withColumn("pbest_fit", r6(F.col("pbest_fit"))),
                       ["grp", "pid", "pbest_fit"], {"pos": "pos", "vel": "vel", "pbest": "pbest"})

    return query


def _trained_demand(spark, sf_dir, settings, network):
    return fit(demand(spark, sf_dir), ["grp"], network, "mse", settings, draw=lattice)


def _train(settings, network):
    def query(spark, sf_dir):
        weights = _trained_demand(spark, sf_dir, settings, network).weights
        return spelled(weights.withColumn("fit", r6(F.col("fit"))), ["grp", "fit"], {"pos": "pos"})

    return query


def _train_class(loss):
    def query(spark, sf_dir):
        trained = fit(vectors(spark, sf_dir), ["grp"], SMALL_CLASSIFIER, loss, CLASS_SWARM, draw=lattice)
        return spelled(trained.weights.withColumn("fit", r6(F.col("fit"))), ["grp", "fit"], {"pos": "pos"})

    return query


def curve(spark, sf_dir):
    trained = _trained_demand(spark, sf_dir, FREE, SMALL)
    steps = trained.curve.withColumnRenamed("best_fitness", "fit")
    return monotone_curve(steps, ["grp"]).select(
        "grp", F.col("iter").cast("long").alias("iter"), r6(F.col("best_fitness")).alias("best_fitness")
    )


def curve_compare(spark, sf_dir):
    stacked = stack_curves({
        "sync": _trained_demand(spark, sf_dir, FREE, SMALL).curve,
        "async": _trained_demand(spark, sf_dir, BOUNDED, SMALL_LINEAR).curve,
    })
    return compare_curves(stacked, ["grp"]).select(
        "algo", "grp", r6(F.col("first_fitness")).alias("first_fitness"), r6(F.col("best_fitness")).alias("best_fitness"),
        F.col("reached_at").cast("long").alias("reached_at"), "n_iters",
    )


def sweep_runs(spark, sf_dir):
    trained = sweep(demand(spark, sf_dir), ["grp"], SWEEP_ROWS, SWEEP_ITERATIONS, SWEEP_PARTICLES, SMALL, "mse", FREE,
                    draw=lattice)
    return trained.weights.select("run_id", "grp", r6(F.col("fit")).alias("fit"))


# ---- wide vocabularies ---------------------------------------------------------------------------

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def onehot_wide(spark, sf_dir):
    """Where the one stands in the one-hot vector of every part number, over order lines, by first appearance."""
    lines = mixed(spark, sf_dir).select(*LINE_KEYS, "line")
    numbered = wide.number_values(lines, "l_partkey", "line")
    return wide.look_up(lines, "l_partkey", numbered, "place").select(*LINE_KEYS, "place")


def sparse_wide(spark, sf_dir):
    """Scores of sparse vectors of part number, return flag and quantity."""
    lines = mixed(spark, sf_dir).select(*LINE_KEYS, "l_returnflag", "l_quantity", "line")
    features, width = wide.assemble_with_width(lines, ["l_partkey", "l_returnflag"], ["l_quantity"], "line")
    weights = spark.range(width).select(F.col("id").alias("index"), ((F.col("id") * 7919) % 1000 / F.lit(1000.0)).alias("weight"))
    return wide.sparse_scores(features, LINE_KEYS, "x", weights).select(*LINE_KEYS, r6(F.col("score")).alias("score"))


# ---- text files, written and read again ----------------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    """Events as delimited text, read back and numbered in the order of the files."""
    path = Scratch(spark).path("events")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").write.option("header", True).csv(path)
    read = text.read_delimited(spark, path, events.columns)
    return wide.number_rows(read, ["row_id"], Scratch(spark)).select(
        "number", F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value")
    )


def cells_roundtrip(spark, sf_dir):
    """Models as lines of weights, read back as cells."""
    path = Scratch(spark).path("weights")
    models = lattice_weights(demand(spark, sf_dir), SMALL, DEMAND_INPUTS, 0.5)
    sinks.write_weights_text(models, path)
    cells = text.read_cells(spark, path).select(F.transform("cells", lambda c: c.cast("double")).alias("pos"))
    return cells.select(F.size("pos").cast("long").alias("n_weights"), *[r6(F.col("pos")[i]).alias(f"w{i}") for i in (0, 1, 44)])


def curve_file(spark, sf_dir):
    path = Scratch(spark).path("curves")
    sinks.write_curve_text(_trained_demand(spark, sf_dir, FREE, SMALL).curve, path)
    return text.read_curve(spark, path, "sync", ["grp"]).select(
        "algo", "grp", F.col("iter").cast("long").alias("iter"), r6(F.col("best_fitness")).alias("best_fitness")
    )


def class_results_file(spark, sf_dir):
    """Two runs appended to the results of a classification."""
    path = Scratch(spark).path("results")
    for _ in range(2):
        sinks.write_class_results(_vector_scores(spark, sf_dir), path)
    pairs = text.read_cells(spark, path).select(*[F.col("cells")[i].cast("double").alias(c) for i, c in enumerate(("real", "predicted"))])
    return pairs.groupBy("real", "predicted").agg(F.count("*").alias("n_rows"))


def runs_file(spark, sf_dir):
    path = Scratch(spark).path("runs")
    sinks.write_runs_text(_trained_demand(spark, sf_dir, FREE, SMALL).runs, path)
    cells = text.read_cells(spark, path, ["metric"]).where("metric = 'train_mse'")
    facts = [F.col("cells")[i].cast("long").alias(c) for i, c in enumerate(("iters", "parts", "n_rows"))]
    return cells.select("metric", *facts, r6(F.col("cells")[3].cast("double")).alias("value"))


def registered() -> dict[str, Query]:
    return {
        "clean_limit": clean_limit,
        "limit_large": limit_large,
        "leading_columns": leading_columns,
        "fixed_decimals": fixed_decimals,
        "label_decode": label_decode,
        "calendar_parts": calendar_parts,
        "onehot_first_seen": onehot_first_seen,
        "assemble_calendar": assemble_calendar,
        "assemble_mixed": assemble_mixed,
        "dims": dims,
        "linear_predict": linear_predict,
        "activations": activations,
        "forward_identity": _forward(demand, LINEAR_REGRESSOR, DEMAND_INPUTS, 0.5),
        "forward_tanh": _forward(demand, REGRESSOR, DEMAND_INPUTS, 0.5),
        "forward_class": _forward(vectors, CLASSIFIER, VECTOR_INPUTS, 0.5),
        "forward_two_layer": _forward(vectors, DEEP_CLASSIFIER, VECTOR_INPUTS, 0.5),
        "hourly_predict": hourly_predict,
        "class_predict": class_predict,
        "predict_unlabelled": predict_unlabelled,
        "in_out_errors": in_out_errors,
        "report_lines": report_lines,
        "model_lines": model_lines,
        "rows_per_hour": rows_per_hour,
        "hourly_mse": hourly_mse,
        "macro_mse": macro_mse,
        "pair_mse": pair_mse,
        "accuracy": accuracy,
        "class_counts": class_counts,
        "f1": f1,
        "bce": bce,
        "auc": auc,
        "auc_hourly": auc_hourly,
        "auc_literal": auc_literal,
        "summary": summary,
        "loss_error": _loss("error"),
        "loss_bce": _loss("bce"),
        "loss_mse": _loss("mse"),
        "loss_f1": _loss("f1"),
        "loss_f1_signum": _loss("f1", "signum"),
        "loss_auc": _loss("auc"),
        "evaluate_error": _evaluate("error"),
        "evaluate_bce": evaluate_bce,
        "evaluate_limit": evaluate_limit,
        "evaluate_f1": _evaluate("f1"),
        "evaluate_f1_signum": _evaluate("f1", decision="signum"),
        "evaluate_auc": _evaluate("auc"),
        "swarm_init": swarm_init,
        "swarm_fitness": swarm_fitness,
        "swarm_fitness_expression": swarm_fitness_expression,
        "swarm_pbest": swarm_pbest,
        "swarm_gbest": swarm_gbest,
        "swarm_gbest_running": swarm_gbest_running,
        "swarm_move_free": _move(FREE),
        "swarm_move_bounded": _move(BOUNDED),
        "swarm_move_personal": _move(PERSONAL),
        "generation_sync": _generations(FREE, SMALL),
        "generation_async": _generations(BOUNDED, SMALL_LINEAR),
        "train_sync": _train(FREE, SMALL),
        "train_async": _train(BOUNDED, SMALL),
        "train_published_width": _train(PUBLISHED, REGRESSOR),
        "train_per_hour": _train(BOUNDED, SMALL_LINEAR),
        "train_personal": _train(PERSONAL, SMALL_LINEAR),
        "train_class_bce": _train_class("bce"),
        "train_class_auc": _train_class("auc"),
        "curve": curve,
        "curve_compare": curve_compare,
        "sweep": sweep_runs,
        "onehot_wide": onehot_wide,
        "sparse_wide": sparse_wide,
        "csv_roundtrip": csv_roundtrip,
        "cells_roundtrip": cells_roundtrip,
        "curve_file": curve_file,
        "class_results_file": class_results_file,
        "runs_file": runs_file,
    }
