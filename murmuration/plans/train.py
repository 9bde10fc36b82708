"""Training by particle swarm: all groups and all runs advance together, one Spark job per generation."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.draws import Draw, hashed
from murmuration.network import CLASSIFIER, LINEAR_REGRESSOR, REGRESSOR, Network
from murmuration.operators.blocks import PackedTable, pack_blocks
from murmuration.operators.fitness import LOSSES, chunk_fitness
from murmuration.operators.meeting import BROADCAST_BYTES
from murmuration.operators.packed_swarm import PackedGeneration, leaders, pack_swarm
from murmuration.operators.swarm import (
    LEADER,
    best_seen,
    init_swarm,
    new_position,
    new_velocity,
    pulls,
)
from murmuration.sources.scratch import Scratch


@dataclass(frozen=True)
class SwarmSettings:
    """``update='sync'`` refreshes the global best once per generation, ``'async'`` after every particle."""

    particles: int = 100
    iterations: int = 100
    inertia: float = 1.0
    c1: float = 0.8
    c2: float = 0.2
    v_max: float = 10.0
    pos_max: float | None = None
    init_range: float = 100.0
    update: str = "sync"
    social: str = "global"
    seed: int = 0

    def __post_init__(self):
        if self.update not in ("sync", "async"):
            raise ValueError("update must be 'sync' or 'async'")
        if self.social not in ("global", "personal"):
            raise ValueError("social must be 'global' or 'personal'")
        if self.particles < 1 or self.iterations < 1:
            raise ValueError("at least one particle and one iteration")


# Fixed values of the published set-ups.
DEMAND_SYNC = (REGRESSOR, SwarmSettings())
DEMAND_ASYNC = (LINEAR_REGRESSOR, SwarmSettings(v_max=0.48, pos_max=0.8, init_range=0.8, update="async"))
SMOKER_SYNC = (CLASSIFIER, SwarmSettings(c1=3.5, c2=1.8, v_max=0.1, pos_max=1.0, init_range=1.0))


@dataclass
class Trained:
    """``weights(run_id, *group, pos, fit)``, ``curve(run_id, *group, iter, best_fitness)`` and
    ``runs(run_id, iters, parts, rows, metric, value)`` with the training time and the mean loss of the groups."""

    weights: DataFrame
    curve: DataFrame
    runs: DataFrame
    seconds: float
    n_inputs: int
    network: Network
    scratch: Scratch

    def close(self) -> None:
        """Delete the stored tables; nothing of the result can be read afterwards."""
        self.scratch.drop()


class Generation:
    """One generation in row form: personal bests, global best, move, and the leader row of each group.

    ``train_runs`` does the same on packed chunks (``operators.packed_swarm``).

    Call it with ``state`` (particles and one leader row per group, each with the number of steps done)
    and ``fits`` (``*keys, pid, fit``).  Who is best is found on the fitness alone; then the positions of the record
    holders are joined to the particles, so whole particles are neither shuffled nor sorted when the small sides can
    be broadcast.  ``store`` keeps the narrow table between the two steps.  The step number is data, so every
    generation runs the same compiled code.  In the first generation of an asynchronous run every particle already
    knows the best of the start.
    """

    def __init__(self, keys: list[str], settings: SwarmSettings, draw: Draw = hashed,
                 draw_keys: list[str] | None = None, small: bool = True):
        group = [F.col(k) for k in (draw_keys or keys)]
        self.keys, self.on = keys, [*keys, "pid"]
        self.asynchronous = settings.update == "async"
        self.pulls = pulls(settings.c1, settings.c2, settings.seed, group, F.col("step") + 1, draw).alias("pulls")
        self.velocity = new_velocity(settings.inertia, settings.v_max, settings.social).alias("moved")
        self.pos_max = settings.pos_max
        self.beside = F.broadcast if small else (lambda df: df)

    def judged(self, state: DataFrame, fits: DataFrame, first: bool) -> DataFrame:
        """``*keys, pid``, the new ``pbest_fit``, whether it is ``better``, and who is best: narrow rows."""
        known = state.select(*self.on, F.col("pbest_fit").alias("old_fit")).join(self.beside(fits), self.on, "left")
        better = F.coalesce(F.col("fit") < F.col("old_fit"), F.lit(False))
        narrow = known.select(
            *self.on, better.alias("better"), F.when(better, F.col("fit")).otherwise(F.col("old_fit")).alias("pbest_fit")
        )
        seen = best_seen(narrow, self.keys, self.asynchronous and not first)
        holder = F.when(F.col("pid") == LEADER, F.col("lead_pid")).otherwise(F.col("best_pid"))
        return seen.select(*self.on, "better", "pbest_fit", holder.alias("holder"), "lead_fit")

    def __call__(self, state: DataFrame, fits: DataFrame, first: bool, store=lambda df: df) -> DataFrame:
        judged = store(self.judged(state, fits, first))
        holders = judged.select(*self.keys, F.col("holder").alias("pid")).distinct()
        own = F.when(F.col("better"), F.col("pos")).otherwise(F.col("pbest"))
        chosen = judged.join(self.beside(holders), self.on, "left_semi").select(*self.on, "better")
        positions = state.select(*self.on, "pos", "pbest").join(self.beside(chosen), self.on).select(
            *self.keys, F.col("pid").alias("holder"), own.alias("gbest")
        )
        rest = [c for c in state.columns if c not in ("pbest", "pbest_fit", "vel", "history", "step")]
        led = state.drop("pbest_fit").join(self.beside(judged), self.on).join(
            self.beside(positions), [*self.keys, "holder"]
        )
        leads = F.col("pid") == LEADER
        pulled = led.select(*rest, "vel", "step", "history", "gbest", "lead_fit", "pbest_fit", own.alias("pbest"), self.pulls)
        moved = pulled.select(*rest, "step", "history", "gbest", "lead_fit", "pbest_fit", "pbest", self.velocity)
        final = {
            "step": F.col("step") + 1,
            "pos": new_position("moved", self.pos_max),
            "vel": F.col("moved"),
            "pbest": F.when(leads, F.col("gbest")).otherwise(F.col("pbest")),
            "pbest_fit": F.when(leads, F.col("lead_fit")).otherwise(F.col("pbest_fit")),
            "history": F.when(leads, F.concat("history", F.array("lead_fit"))).otherwise(F.col("history")),
        }
        return moved.select(*[final[c].alias(c) if c in final else c for c in state.columns])


def with_leaders(swarm: DataFrame) -> DataFrame:
    """Add one leader row per group, taken from particle 0 and not yet evaluated."""
    leader = swarm.where(F.col("pid") == 0).withColumn("pid", F.lit(LEADER).cast("long"))
    return swarm.unionByName(leader).withColumns({
        "step": F.lit(0), "history": F.array().cast("array<double>")
    })


def train_runs(table: PackedTable, runs: list[dict], group: list[str], network: Network, loss: str,
               settings: SwarmSettings, decision: str = "threshold", draw: Draw = hashed,
               broadcast_bytes: int = BROADCAST_BYTES) -> Trained:
    """Train every run of ``runs`` (``run_id, iters, parts, tier, rows``) on every group, side by side.

    The blocks carry ``tier``; a run sees the blocks of its own and all lower tiers.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    spark = table.blocks.sparkSession
    scratch = Scratch(spark)
    began = time.perf_counter()
    keys = ["run_id", *group]
    width = network.n_weights(table.n_inputs)
    # One row per group and run; both lists come from the settings and the group keys.
    present = table.blocks.groupBy(*group).agg(F.min("tier").alias("from_tier"), F.sum("n").alias("n_rows"))
    present = scratch.store(present, "groups")
    listed = F.array(*[
        F.struct(*[F.lit(r[c]).alias(c) for c in ("run_id", "iters", "parts", "tier")]) for r in runs
    ])
    seats = (
        present.withColumn("run", F.explode(listed)).where(F.col("run.tier") >= F.col("from_tier"))
        .select(*group, "n_rows", "run.run_id", "run.iters", "run.parts", "run.tier")
    )
    swarm = init_swarm(seats, keys, F.col("parts"), width, settings.init_range, settings.seed, draw, group,
                       spread=True)
    n_groups = present.count()
    swarm_bytes = 8 * width * n_groups * sum(r["parts"] * (r["tier"] + 1) for r in runs)
    if swarm_bytes > broadcast_bytes:
        table.partition_for_joins()
    found = _advance(scratch, swarm, table, runs, group, keys, network, loss, settings, decision, draw, swarm_bytes,
                     broadcast_bytes)
    final = scratch.store(found, "leaders")
    scratch.drop("groups", *[n for n in scratch.names() if n.startswith(("generation", "final"))])
    seconds = time.perf_counter() - began
    facts = spark.createDataFrame(
        [(r["run_id"], r["iters"], r["parts"], r["rows"], seconds) for r in runs],
        "run_id string, iters int, parts int, rows long, seconds double",
    )
    error = final.groupBy("run_id").agg(F.avg("pbest_fit").alias("error"))
    record = facts.join(error, "run_id", "left").select(
        "run_id", "iters", "parts", "rows",
        F.explode(F.create_map(F.lit("train_seconds"), "seconds", F.lit(f"train_{loss}"), "error")).alias("metric", "value"),
    )
    return Trained(
        weights=final.select(*keys, F.col("pbest").alias("pos"), F.col("pbest_fit").alias("fit")),
        curve=final.select(*keys, F.posexplode("history").alias("iter", "best_fitness")),
        runs=record,
        seconds=seconds,
        n_inputs=table.n_inputs,
        network=network,
        scratch=scratch,
    )


def _advance(scratch, swarm, table, runs, group, keys, network, loss, settings, decision, draw, swarm_bytes,
             broadcast_bytes) -> DataFrame:
    """The leaders of all groups and runs.  Each generation ends in one stored table."""
    width = network.n_weights(table.n_inputs)
    state = scratch.store(pack_swarm(swarm, keys, width), "generation-0")
    top_tier = max(r["tier"] for r in runs)
    ends = {r["iters"] for r in runs}
    small = swarm_bytes <= broadcast_bytes  # what is broadcast beside the swarm is smaller than the swarm
    generation = PackedGeneration(keys, settings, draw, group, small)
    found = []
    for step in range(1, max(ends) + 1):
        active = state.where(F.col("iters") >= step) if len(ends) > 1 else state
        chunks = generation.moved(active, step)
        if top_tier:
            chunks = chunks.withColumn("tier", F.explode(F.sequence(F.lit(0), F.col("tier"))))
        fits, shared = chunk_fitness(table.blocks, chunks, [*group, "tier"], keys, network, table.n_inputs, loss, swarm_bytes,
                                     table.hot, decision, broadcast_bytes)
        state = scratch.store(generation.judged(active, fits, step), f"generation-{step % 2 + 1}")
        if shared is not None:
            shared.destroy()
        if step in ends:
            found.append(scratch.store(leaders(state.where(F.col("iters") == step), keys), f"final-{step}"))
    return reduce(DataFrame.unionByName, found)


def fit(df: DataFrame, group: list[str], network: Network = REGRESSOR, loss: str = "mse",
        settings: SwarmSettings = SwarmSettings(), x: str = "x", y: str = "y", run_id: str = "run",
        decision: str = "threshold", draw: Draw = hashed, broadcast_bytes: int = BROADCAST_BYTES,
        **changes) -> Trained:
    """Train one network per value of ``group`` on all rows of ``df``; a null group stops the training.

    Keyword ``changes`` override single settings, for example ``iterations=20``.
    """
    settings = replace(settings, **changes)
    table = PackedTable(
        pack_blocks(df.withColumn("tier", F.lit(0)), [*group, "tier"], x, y), [*group, "tier"]
    )
    try:
        run = {"run_id": run_id, "iters": settings.iterations, "parts": settings.particles, "tier": 0,
               "rows": table.n_rows}
        return train_runs(table, [run], group, network, loss, settings, decision, draw, broadcast_bytes)
    finally:
        table.close()
