"""Fitness: every particle of a group meets every row of that group.

The rows stay where they are, packed in blocks; the particles come to them.  A pass emits only partial
sums per particle, which Spark adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from murmuration.network import Network
from murmuration.operators import kernels
from murmuration.operators.meeting import BROADCAST_BYTES, meet
from murmuration.operators.ranking import auc

LOSSES = ("mse", "error", "bce", "f1", "auc")
CHUNK_BYTES = 4 << 20
_HELD_SUMS = 1 << 20
_SCORED_AT_ONCE = 1 << 20  # scores (rows x particles) in memory, 8 MB


def per_chunk(n_weights: int) -> int:
    """Particles of a chunk."""
    return max(1, CHUNK_BYTES // (8 * n_weights))


def chunk_particles(swarm: DataFrame, keys: list[str], n_weights: int) -> DataFrame:
    """Gather particles into rows of at most about 4 MB: ``*keys, pids, flat``."""
    members = F.array_sort(F.collect_list(F.struct("pid", "pos")))
    return (
        swarm.groupBy(*keys, F.floor(F.col("pid") / F.lit(per_chunk(n_weights))).alias("chunk"))
        .agg(members.alias("members"))
        .select(*keys, F.col("members.pid").alias("pids"), F.flatten("members.pos").alias("flat"))
    )


def _rows_of(batch, i):
    n, d = batch.column("n")[i].as_py(), batch.column("d")[i].as_py()
    x = np.frombuffer(batch.column("bx")[i].as_buffer(), dtype=np.float64).reshape(n, d)
    return x, np.frombuffer(batch.column("by")[i].as_buffer(), dtype=np.float64)


def _joined(keys):
    """Every block with the particles that a join has put beside it: key, rows, targets, particles, weights."""
    def meetings(batch):
        for i in range(batch.num_rows):
            flat = batch.column("flat")[i]
            flat = np.frombuffer(flat.as_buffer()) if isinstance(flat, pa.BinaryScalar) else flat.values.to_numpy(zero_copy_only=False)
            pids = batch.column("pids")[i].values.to_numpy(zero_copy_only=False)
            yield tuple(batch.column(k)[i].as_py() for k in keys), *_rows_of(batch, i), pids, flat.reshape(len(pids), -1)

    return meetings


def _resident(on, swarm):
    """Every block with the particles of its group, out of the swarm that each task has."""
    def meetings(batch):
        for i in range(batch.num_rows):
            here = swarm.value.get(tuple(batch.column(k)[i].as_py() for k in on), ())
            if here:
                x, y = _rows_of(batch, i)
                for key, pids, weights in here:
                    yield key, x, y, pids, weights

    return meetings


def _parts(x, y, weights, net, loss, decision):
    """The additive parts of a loss over a block, by slices of its rows: the scores of a wide swarm are far more than the block."""
    at_once = max(1, _SCORED_AT_ONCE // len(weights))
    return sum(
        kernels.loss_parts(y[i : i + at_once], kernels.network_outputs(x[i : i + at_once], weights, *net), loss, decision)
        for i in range(0, len(y), at_once)
    )


def _summer(meetings, key_types, net, loss, decision):
    def run(batches):
        held, size = {}, 0
        names = [*[f"k{j}" for j in range(len(key_types))], "pid", "n", "s0", "s1", "s2"]

        def flush():
            rows = [(key, n, parts, pids) for (key, _), (n, parts, pids) in held.items()]
            counts = [len(r[3]) for r in rows]
            columns = [
                pa.array([r[0][j] for r in rows], type=kind).take(pa.array(np.repeat(np.arange(len(rows)), counts)))
                for j, kind in enumerate(key_types)
            ]
            columns.append(pa.array(np.concatenate([r[3] for r in rows]), type=pa.int64()))
            columns.append(pa.array(np.repeat([r[1] for r in rows], counts), type=pa.int64()))
            parts = np.concatenate([r[2] for r in rows])
            columns += [pa.array(np.ascontiguousarray(parts[:, j])) for j in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def add(batch):
            """Its own function: no array of the batch outlives it while the next one is read."""
            nonlocal size
            for key, x, y, pids, weights in meetings(batch):
                parts = _parts(x, y, weights, net, loss, decision)
                slot = (key, int(pids[0]))
                if slot in held:
                    old = held[slot]
                    held[slot] = (old[0] + len(y), old[1] + parts, old[2])
                else:
                    held[slot] = (len(y), parts, np.array(pids))
                    size += parts.size

        for batch in batches:
            add(batch)
            del batch
            if size > _HELD_SUMS:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return run


def _scorer(meetings, key_types, net):
    """Per block and particle: distinct scores with their numbers of positives and negatives."""

    def run(batches):
        names = [*[f"k{j}" for j in range(len(key_types))], "pid", "score", "positives", "negatives"]
        for batch in batches:
            for key, x, y, pids, weights in meetings(batch):
                at_once = max(1, _SCORED_AT_ONCE // len(y))
                for start in range(0, len(pids), at_once):
                    scores = kernels.network_outputs(x, weights[start : start + at_once], *net)
                    found = []
                    for j, pid in enumerate(pids[start : start + at_once]):
                        values, where = np.unique(scores[:, j], return_inverse=True)
                        positives = np.bincount(where, weights=(y == 1.0), minlength=len(values))
                        found.append((np.full(len(values), pid), values, positives,
                                      np.bincount(where, minlength=len(values)) - positives))
                    pid, values, positives, negatives = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * len(values), type=kind) for v, kind in zip(key, key_types)]
                        + [pa.array(pid, type=pa.int64()), pa.array(values), pa.array(positives.astype(np.int64)),
                           pa.array(negatives.astype(np.int64))],
                        names=names,
                    )

    return run


def net_arguments(network: Network, n_inputs: int) -> tuple:
    return (network.hidden, network.output, network.layers, network.width(n_inputs))


def loss_value(loss: str) -> Column:
    """The loss from its summed parts; an undefined F1 is null."""
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    if loss in ("mse", "error"):
        return s0 / n
    if loss == "bce":
        return s0
    precision, recall = F.try_divide(s0, s0 + s1), F.try_divide(s0, s0 + s2)
    return F.lit(1.0) - F.try_divide(F.lit(2.0) * (precision * recall), precision + recall)


def fitness(blocks: DataFrame, swarm: DataFrame, on: list[str], keys: list[str], network: Network,
            n_inputs: int, loss: str, swarm_bytes: int | None = None, hot: DataFrame | None = None, decision: str = "threshold",
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``*keys, pid, fit`` for every particle.

    ``on`` are the keys shared with the blocks, ``keys`` all keys; ``hot`` names the split groups of blocks
    that are partitioned for swarms too big to broadcast.  ``swarm_bytes`` is measured if it is not known.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if swarm_bytes is None:
        swarm_bytes = 8 * network.n_weights(n_inputs) * swarm.count()
    tiered = [*keys, *[c for c in on if c not in keys]]
    chunks = chunk_particles(swarm.select(*tiered, "pid", "pos"), tiered, network.n_weights(n_inputs))
    met = meet(blocks, chunks, on, swarm_bytes, hot, broadcast_bytes=broadcast_bytes).select(
        *keys, "n", "d", "bx", "by", "pids", "flat"
    )
    return _evaluate(met, _joined(tuple(keys)), [met.schema[k] for k in keys], network, n_inputs, loss, decision)


def _evaluate(met: DataFrame, meetings, key_fields: list[T.StructField], network: Network, n_inputs: int, loss: str,
              decision: str, chunk: Column | None = None) -> DataFrame:
    """``*keys, pid, fit``; with ``chunk``, an expression of ``pid``, the sums are gathered by (keys, chunk)."""
    keys = [f.name for f in key_fields]
    kinds = [to_arrow_type(f.dataType) for f in key_fields]
    net = net_arguments(network, n_inputs)
    named = [T.StructField(f"k{j}", f.dataType) for j, f in enumerate(key_fields)] + [T.StructField("pid", T.LongType())]
    back = {f"k{j}": k for j, k in enumerate(keys)}
    if loss == "auc":
        scored = met.mapInArrow(_scorer(meetings, kinds, net), T.StructType([
            *named, T.StructField("score", T.DoubleType()),
            T.StructField("positives", T.LongType()), T.StructField("negatives", T.LongType()),
        ])).withColumnsRenamed(back)
        area = auc(scored, by=[*keys, "pid"], counted=True)
        return area.select(*keys, "pid", (F.lit(1.0) - F.col("auc")).alias("fit"))
    sums = met.mapInArrow(_summer(meetings, kinds, net, loss, decision), T.StructType([
        *named, T.StructField("n", T.LongType()), *[T.StructField(f"s{j}", T.DoubleType()) for j in range(3)],
    ])).withColumnsRenamed(back)
    by = [*keys, "pid"]
    if chunk is not None:  # the tasks have added up their rows, so nothing is lost by dealing chunks first
        sums = sums.withColumn("chunk", chunk).repartition(*keys, "chunk")
        by = [*keys, "chunk", "pid"]
    return (
        sums.groupBy(*by)
        .agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(3)])
        .select(*by, loss_value(loss).alias("fit"))
    )


def chunk_fitness(blocks: DataFrame, chunks: DataFrame, on: list[str], keys: list[str], network: Network, n_inputs: int,
                  loss: str, swarm_bytes: int, hot: DataFrame | None = None, decision: str = "threshold",
                  broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, Broadcast | None]:
    """``*keys, chunk, fits`` for chunks of particles ``*keys, *on, chunk, pids, flat`` (binary); ``fits`` has pid and fit.

    A swarm of at most ``broadcast_bytes`` stays in the tasks, once for all blocks; its handle is returned, to be
    destroyed after use.  A larger one is joined with the blocks.
    """
    shared = None
    key_fields = [chunks.schema[k] for k in keys]
    if swarm_bytes <= broadcast_bytes:
        held = {}
        table = chunks.toArrow()
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                pids = batch.column("pids")[i].values.to_numpy(zero_copy_only=False)
                weights = np.frombuffer(batch.column("flat")[i].as_buffer()).reshape(len(pids), -1)
                key, place = (tuple(batch.column(k)[i].as_py() for k in names) for names in (keys, on))
                held.setdefault(place, []).append((key, pids, weights))
        shared = blocks.sparkSession.sparkContext.broadcast(held)
        met, meetings = blocks.select(*on, "n", "d", "bx", "by"), _resident(tuple(on), shared)
    else:
        met = meet(blocks, chunks, on, swarm_bytes, hot, broadcast_bytes=broadcast_bytes).select(
            *keys, "n", "d", "bx", "by", "pids", "flat"
        )
        meetings = _joined(tuple(keys))
    chunk = F.floor(F.col("pid") / F.lit(per_chunk(network.n_weights(n_inputs))))
    fits = _evaluate(met, meetings, key_fields, network, n_inputs, loss, decision, chunk)
    gathered = F.array_sort(F.collect_list(F.struct("pid", "fit"))).alias("fits")
    return fits.groupBy(*keys, chunk.alias("chunk")).agg(gathered) if loss == "auc" else fits.groupBy(*keys, "chunk").agg(gathered), shared
