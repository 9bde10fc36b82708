"""Scoring: every row of a group through the model of that group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.functions.forward import forward
from murmuration.functions.scalar import threshold
from murmuration.network import Network
from murmuration.operators import kernels
from murmuration.operators.blocks import BLOCK_BYTES
from murmuration.operators.fitness import net_arguments
from murmuration.operators.meeting import BROADCAST_BYTES, meet


def _scores(x, positions, net):
    """Scores of a list column through the model of each row, by row number in ``positions``; null without one."""
    out, known = np.full(len(x), np.nan), np.zeros(len(x), bool)
    for weights, rows in positions:
        values = x.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[rows] = kernels.network_outputs(values.reshape(len(rows), -1), weights[None, :], *net)[:, 0]
        known[rows] = True
    return pa.array(out, mask=~known)


def _by_key(batch, keys):
    """Row numbers of each key of a batch."""
    frame = pa.Table.from_batches([batch.select(list(keys))]).to_pandas()
    for rows in frame.groupby(list(keys), sort=False, dropna=False).indices.values():
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in keys), rows


def _predictor(keys, net, models):
    """One pass over rows with all models at hand."""
    def run(batches):
        known = models.value
        for batch in batches:
            usable = np.flatnonzero(batch.column("_x").is_valid().to_numpy(zero_copy_only=False))
            found = [(known[key], rows[np.isin(rows, usable)]) for key, rows in _by_key(batch, keys) if key in known]
            score = _scores(batch.column("_x"), [(w, rows) for w, rows in found if len(rows)], net)
            plain = batch.drop_columns(["_x"])
            yield pa.RecordBatch.from_arrays([*plain.columns, score], names=[*plain.schema.names, "score"])

    return run


def _bundler(keys, most):
    """Rows of one group, up to ``most`` bytes, as one binary cell in Arrow's stream format."""
    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            per = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
            for key, rows in _by_key(batch, keys):
                for start in range(0, len(rows), per):
                    part = batch.take(pa.array(rows[start : start + per]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    columns = [pa.array([v], type=batch.schema.field(k).type) for k, v in zip(keys, key)]
                    columns += [pa.array([serial]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "block", "bundle"])
                    serial += 1

    return run


def _bundle_predictor(net):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.ipc.open_stream(batch.column("bundle")[i].as_buffer()).read_next_batch()
                model = batch.column("pos")[i]
                usable = np.flatnonzero(rows.column("_x").is_valid().to_numpy(zero_copy_only=False))
                known = [(model.values.to_numpy(zero_copy_only=False), usable)] if model.is_valid and len(usable) else []
                score, plain = _scores(rows.column("_x"), known, net), rows.drop_columns(["_x"])
                yield pa.RecordBatch.from_arrays([*plain.columns, score], names=[*plain.schema.names, "score"])

    return run


def predict(df: DataFrame, weights: DataFrame, group: list[str], network: Network, n_inputs: int,
            x: str = "x", y: str | None = "y", row_id: str | None = "row_id", decide_at: float | None = None,
            keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``*group, row_id, real, predicted`` (and ``score`` for classes) for every row.

    ``weights`` has one row per group: ``*group, pos``.  Without targets (``y=None``) there is no ``real``; ``row_id``
    is of any type; the columns ``keep`` come along.  The size of all models is measured: up to ``broadcast_bytes``
    every task has them and rows are read once, beyond it bundles of rows meet the models of their group in a sharded
    join.  Rows without features and rows of a group without a model keep a null prediction, and so do
    rows whose group is null in any column, whatever the models: both ways give the same answers.
    """
    named = [*([F.col(row_id).alias("row_id")] if row_id else []), *([F.col(y).cast("double").alias("real")] if y else [])]
    source = df.select(*group, *named, *(keep or []), F.col(x).cast("array<double>").alias("_x"))
    fields = [f for f in source.schema.fields if f.name != "_x"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    models = weights.select(*group, "pos")
    weight_bytes = 8 * (models.agg(F.sum(F.size("pos"))).first()[0] or 0)
    net = net_arguments(network, n_inputs)
    if weight_bytes <= broadcast_bytes:
        table, known = models.toArrow(), {}  # measured above
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in group)
                if None not in key:
                    known[key] = batch.column("pos")[i].values.to_numpy(zero_copy_only=False)
        scored = source.mapInArrow(_predictor(tuple(group), net, df.sparkSession.sparkContext.broadcast(known)), schema)
    else:
        bundled = T.StructType([*[source.schema[k] for k in group], T.StructField("block", T.LongType()),
                                T.StructField("bundle", T.BinaryType())])
        bundles = source.mapInArrow(_bundler(tuple(group), BLOCK_BYTES), bundled)
        met = meet(bundles, models, group, weight_bytes, how="left", broadcast_bytes=broadcast_bytes)
        scored = met.select("bundle", "pos").mapInArrow(_bundle_predictor(net), schema)
    if decide_at is None:
        return scored.withColumnRenamed("score", "predicted")
    return scored.withColumn("predicted", decide(F.col("score"), decide_at))


def decide(score: Column, at: float = 0.5) -> Column:
    """Class of a score; an unknown score stays unknown."""
    return F.when(score.isNotNull(), threshold(score, at))


def predict_expression(df: DataFrame, weights: DataFrame, group: list[str], network: Network, n_inputs: int,
                       x: str = "x", output: str = "predicted") -> DataFrame:
    """Scoring with Column expressions only; keeps every column of ``df``.  For small networks."""
    models = weights.select(*group, F.col("pos").alias("_model"))
    return (
        df.join(models, group, "left")
        .withColumn(output, forward(F.col(x), F.col("_model"), n_inputs, network))
        .drop("_model")
    )
