"""Swarms as matrices: one row of the table holds a chunk of the particles of a group, at most about 4 MB of positions.

A row has ``*keys, chunk``, the particles ``pids`` in order and their positions, velocities and personal bests as binary
matrices.  It also names the ``best`` of its particles, so the best of a group, or of all particles before a chunk, is a
window over one narrow row per chunk.  The first chunk of a group carries the leader, the best position of earlier
generations: it comes before all particles and takes part in every comparison.

A generation moves the particles, takes their fitness and judges it.  Moving is cheap and a pure function of the stored
state, so the positions that meet the rows and those that are judged are both computed from it; nothing but the judged
state is stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.functions.draws import Draw, hashed
from murmuration.operators.fitness import per_chunk

BINARIES = ("pos", "vel", "pbest", "pbest_fit")
CARRIED = ("iters", "tier")


def state_schema(source: T.StructType, keys: list[str]) -> T.StructType:
    return T.StructType([
        *[source[k] for k in keys], T.StructField("chunk", T.LongType()), *[source[c] for c in CARRIED],
        T.StructField("step", T.IntegerType()), T.StructField("pids", T.ArrayType(T.LongType())),
        *[T.StructField(c, T.BinaryType()) for c in BINARIES],
        T.StructField("lead_fit", T.DoubleType()), T.StructField("lead_pos", T.BinaryType()),
        T.StructField("best_fit", T.DoubleType()), T.StructField("best_pid", T.LongType()),
        T.StructField("best_pos", T.BinaryType()), T.StructField("history", T.ArrayType(T.DoubleType())),
    ])


def pack_swarm(swarm: DataFrame, keys: list[str], n_weights: int) -> DataFrame:
    """The rows ``*keys, pid, pos, vel, iters, tier`` as chunks that have not been judged yet."""
    members = F.array_sort(F.collect_list(F.struct("pid", "pos", "vel")))
    chunk = F.floor(F.col("pid") / F.lit(per_chunk(n_weights))).alias("chunk")
    gathered = swarm.groupBy(*keys, chunk, *CARRIED).agg(members.alias("m")).select(
        *keys, "chunk", *CARRIED, F.lit(0).alias("step"), F.col("m.pid").alias("pids"), F.flatten("m.pos").alias("pos"),
        F.flatten("m.vel").alias("vel"),
    )
    schema = state_schema(gathered.schema, keys)

    def pack(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                pos, vel = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("pos", "vel"))
                n = len(batch.column("pids")[i])
                first = batch.column("chunk")[i].as_py() == 0
                width = len(pos) // n
                rows.append({
                    "pos": pos.tobytes(), "vel": vel.tobytes(), "pbest": pos.tobytes(),
                    "pbest_fit": np.full(n, np.inf).tobytes(), "lead_fit": np.inf if first else None,
                    "lead_pos": pos[:width].tobytes() if first else None, "best_fit": np.inf, "best_pid": None,
                    "best_pos": None, "history": [],
                })
            yield _batch(batch, schema.names, rows)

    return gathered.mapInArrow(pack, schema)


def _batch(source: pa.RecordBatch, names: list[str], rows: list[dict]) -> pa.RecordBatch:
    """Columns of ``rows`` by name, the others as they are in ``source``."""
    kinds = dict.fromkeys(("pos", "vel", "pbest", "pbest_fit", "lead_pos", "best_pos"), pa.binary()) | {
        "lead_fit": pa.float64(), "best_fit": pa.float64(), "best_pid": pa.int64(), "history": pa.list_(pa.float64()),
        "step": pa.int32(),
    }
    made = set(rows[0]) if rows else set()
    columns = [pa.array([r[n] for r in rows], kinds[n]) if n in made else source.column(n) for n in names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def standings(state: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, chunk, lead, before``: the best of the group and the best of the chunks before, of equals the first particle."""
    best = F.struct("best_fit", "best_pid", "best_pos")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return state.select(*keys, "chunk", best.alias("best")).select(
        *keys, "chunk", F.min("best").over(group).alias("lead"), F.min("best").over(earlier).alias("before")
    )


def leaders(state: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, pbest, pbest_fit, history`` of each group."""
    found = standings(state, keys).where(F.col("chunk") == 0).join(
        state.where(F.col("chunk") == 0).select(*keys, "history"), keys
    ).select(*keys, F.col("lead.best_pos").alias("pbest"), F.col("lead.best_fit").alias("pbest_fit"),
             F.concat("history", F.array("lead.best_fit")).alias("history"))
    schema = T.StructType([f if f.name != "pbest" else T.StructField("pbest", T.ArrayType(T.DoubleType())) for f in found.schema])

    def unpack(batches):
        for batch in batches:
            lists = [np.frombuffer(b.as_buffer()) for b in batch.column("pbest")]
            at = batch.schema.get_field_index("pbest")
            yield batch.set_column(at, "pbest", pa.array(lists, pa.list_(pa.float64())))

    return found.mapInArrow(unpack, schema)


class PackedGeneration:
    """One generation on packed chunks: ``moved`` gives the positions to evaluate, ``judged`` the next state.

    The step number is data, so every generation runs the same compiled code.
    """

    def __init__(self, keys: list[str], settings, draw: Draw = hashed, draw_keys: list[str] | None = None, small: bool = True):
        group = [F.col(k) for k in (draw_keys or keys)]
        self.keys, self.settings = keys, settings
        self.beside = F.broadcast if small else (lambda df: df.hint("merge"))

        def pull(strength: float, number: int) -> Column:
            return F.transform("pids", lambda p: F.lit(float(strength)) * draw(settings.seed, group, p, F.lit(number), F.col("step")))

        self.pulls = [pull(settings.c1, 0).alias("pull_own"), pull(settings.c2, 1).alias("pull_lead")]

    def _placed(self, state: DataFrame, step: int) -> DataFrame:
        """What moving needs: the state with the standings and the random pulls; the start does not move."""
        if step == 1:
            return state
        on = [*self.keys, "chunk"]
        return state.join(self.beside(standings(state, self.keys)), on).select(*state.columns, "lead", "before", *self.pulls)

    def moved(self, state: DataFrame, step: int) -> DataFrame:
        """``*keys, tier, chunk, pids, flat``: the positions of generation ``step``."""
        if step == 1:
            return state.select(*self.keys, "tier", "chunk", "pids", F.col("pos").alias("flat"))
        names = [*self.keys, "tier", "chunk", "pids"]
        schema = T.StructType([*[state.schema[n] for n in names], T.StructField("flat", T.BinaryType())])
        move = self._mover(step)

        def work(batches):
            for batch in batches:
                flat = [move(batch, i)[0].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(flat, pa.binary())], names=[*names, "flat"])

        return self._placed(state, step).mapInArrow(work, schema)

    def judged(self, state: DataFrame, fits: DataFrame, step: int) -> DataFrame:
        """The state after generation ``step`` from ``*keys, chunk, fits`` with the fitness of the moved particles."""
        schema, names = state.schema, state.columns
        move = self._mover(step)

        def work(batches):
            for batch in batches:
                rows = [_judge(batch, i, *move(batch, i)) for i in range(batch.num_rows)]
                yield _batch(batch, names, rows)

        placed = self._placed(state, step).join(fits, [*self.keys, "chunk"], "left")
        return placed.mapInArrow(work, schema)

    def _mover(self, step: int):
        s = self.settings
        running = s.update == "async" and step > 2  # in the first move every particle knows the best of the start
        inertia, v_max, pos_max, personal = s.inertia, s.v_max, s.pos_max, s.social == "personal"

        def move(batch: pa.RecordBatch, i: int):
            """Positions, velocities, personal bests, their fitness, and the leader (fitness, position) of the first chunk."""
            n = len(batch.column("pids")[i])
            pos, vel, own = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c in ("pos", "vel", "pbest"))
            own_fit = np.frombuffer(batch.column("pbest_fit")[i].as_buffer())
            old = batch.column("lead_fit")[i].as_py(), batch.column("lead_pos")[i].as_py()
            if step == 1:
                return pos, vel, own, own_fit, old
            lead = batch.column("lead")[i]
            best = np.frombuffer(lead["best_pos"].as_buffer())
            first = batch.column("chunk")[i].as_py() == 0
            if personal:
                target = own
            elif running:
                before = batch.column("before")[i]
                start = old if first else (before["best_fit"].as_py(), before["best_pos"].as_buffer())
                known = np.minimum.accumulate(np.r_[start[0], own_fit])
                holder = np.maximum.accumulate(np.where(own_fit < known[:-1], np.arange(n), -1))
                target = np.where((holder < 0)[:, None], np.frombuffer(start[1]), own[holder])
            else:
                target = best
            pull, pull_lead = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)[:, None] for c in ("pull_own", "pull_lead"))
            vel = np.clip(inertia * vel + pull * (own - pos) + pull_lead * (target - pos), -v_max, v_max)
            pos = pos + vel
            if pos_max is not None:
                pos = np.clip(pos, -pos_max, pos_max)
            return pos, vel, own, own_fit, (lead["best_fit"].as_py(), best.tobytes()) if first else (None, None)

        return move


def _judge(batch: pa.RecordBatch, i: int, pos, vel, own, own_fit, lead) -> dict:
    n = len(pos)
    fit = np.full(n, np.nan)
    found = batch.column("fits")[i]
    if found.is_valid:
        pids = batch.column("pids")[i].values.to_numpy(zero_copy_only=False)
        values = found.values
        fit[np.searchsorted(pids, values.field("pid").to_numpy(zero_copy_only=False))] = values.field("fit").to_numpy(zero_copy_only=False)
    better = fit < own_fit
    own_fit = np.where(better, fit, own_fit)
    own = np.where(better[:, None], pos, own)
    k = int(np.argmin(own_fit))
    best = float(own_fit[k]), batch.column("pids")[i][k].as_py(), own[k].tobytes()
    if lead[0] is not None and lead[0] <= best[0]:
        best = lead[0], -1, lead[1]
    step, history = batch.column("step")[i].as_py(), batch.column("history")[i].as_py()
    return {
        "step": step + 1, "pos": pos.tobytes(), "vel": vel.tobytes(), "pbest": own.tobytes(), "pbest_fit": own_fit.tobytes(),
        "lead_fit": lead[0], "lead_pos": lead[1], "best_fit": best[0], "best_pid": best[1], "best_pos": best[2],
        "history": history + [lead[0]] if step and lead[0] is not None else history,
    }
