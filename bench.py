"""Times the registered queries and full-size trainings; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (cores).  Names of trainings end in particles x
generations.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "clean_limit", "calendar_parts", "assemble_mixed", "forward_tanh", "hourly_predict", "class_predict",
    "hourly_mse", "macro_mse", "f1", "bce", "auc_hourly", "predict_unlabelled", "limit_large", "loss_bce", "loss_auc", "swarm_fitness",
    "swarm_gbest_running", "swarm_move_bounded", "train_sync", "train_async", "train_per_hour", "sweep",
]


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def sequential(spark, data_of, network, settings, generations: int) -> None:
    """The same training by one process in numpy, for comparison; only ``generations`` of them, as the name says."""
    import numpy as np

    from murmuration.operators.kernels import network_outputs

    table = data_of(spark, SF_DIR).select("grp", "x", "y").toPandas()
    for _, part in table.groupby("grp"):
        x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
        rng = np.random.default_rng(0)
        pos = rng.uniform(-1, 1, (settings.particles, network.n_weights(x.shape[1])))
        vel, own, own_fit = np.zeros_like(pos), pos.copy(), np.full(len(pos), np.inf)
        for _ in range(generations):
            out = network_outputs(x, pos, network.hidden, network.output, network.layers, network.width(x.shape[1]))
            fit_ = np.square(out - y[:, None]).mean(axis=0)
            better = fit_ < own_fit
            own[better], own_fit[better] = pos[better], fit_[better]
            best = own[own_fit.argmin()]
            vel = np.clip(vel + settings.c1 * rng.random((len(pos), 1)) * (own - pos)
                          + settings.c2 * rng.random((len(pos), 1)) * (best - pos), -settings.v_max, settings.v_max)
            pos = pos + vel


def main() -> None:
    from pyspark.sql import SparkSession

    from murmuration import fit
    from murmuration.plans.train import DEMAND_ASYNC, DEMAND_SYNC, SMOKER_SYNC
    from workload.bindings import demand, vectors
    from workload.queries import registered

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    timed(lambda: queries["hourly_mse"](spark, SF_DIR).collect())  # start the JVM and the Python workers

    seconds = {
        name: timed(lambda: queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
        for name in HEADLINE
    }
    full = {  # name: data, network, settings, loss
        "demand_sync": (demand, *DEMAND_SYNC, "mse"),
        "demand_async": (demand, *DEMAND_ASYNC, "mse"),
        "smoker_sync": (vectors, *SMOKER_SYNC, "bce"),
    }
    for name, (data_of, network, settings, loss) in full.items():
        def train():
            fit(data_of(spark, SF_DIR), ["grp"], network, loss, settings, iterations=100).close()

        seconds[f"{name}_100x100"] = timed(train)
    seconds["demand_sequential_numpy_100x10"] = timed(lambda: sequential(spark, demand, *DEMAND_SYNC, 10))
    print(json.dumps({
        "metric": "total seconds of headline queries and full trainings",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
