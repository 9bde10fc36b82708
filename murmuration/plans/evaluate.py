"""Evaluation of stored weights on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.network import CLASSIFIER, Network
from murmuration.operators import metrics
from murmuration.operators.clean import first_rows
from murmuration.operators.meeting import BROADCAST_BYTES
from murmuration.operators.score import predict

METRICS = ("mse", "macro_mse", "error", "accuracy", "bce", "f1", "auc")


def evaluate(df: DataFrame, weights: DataFrame, group: list[str], metric: str, n_inputs: int,
             network: Network = CLASSIFIER, limit: int | None = None, by_group: bool = False,
             decision: str = "threshold", mode: str = "rank",
             broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row, or one row per group, with the metric of ``weights`` on ``df``.

    ``limit`` keeps the first rows by ``row_id``.  ``decision='signum'`` takes the sign of the score as
    the class; ``mode='literal'`` is the running form of the AUC.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = df if limit is None else first_rows(df, limit)
    scored = predict(rows, weights, group, network, n_inputs, decide_at=None,
                     broadcast_bytes=broadcast_bytes)
    by = group if by_group else None
    if metric == "mse":
        return metrics.mse(scored, by=by)
    if metric == "macro_mse":
        return metrics.macro_mse(scored, group)
    if metric == "bce":
        return metrics.cross_entropy(scored, score="predicted", by=by)
    if metric == "auc":
        score = F.signum("predicted") if decision == "signum" else F.col("predicted")
        return metrics.auc(scored.withColumn("score", score), by=by, mode=mode)
    value = F.signum("predicted") if decision == "signum" else F.when(
        F.col("predicted").isNotNull(), F.when(F.col("predicted") < 0.5, 0.0).otherwise(1.0)
    )
    decided = scored.withColumn("predicted", value)
    if metric == "error":
        return metrics.error_rate(decided, by=by)
    if metric == "accuracy":
        return metrics.accuracy(decided, by=by)
    return metrics.f1(decided, by=by)


def error_report(inside: DataFrame, outside: DataFrame, weights: DataFrame, group: list[str], n_inputs: int,
                 network: Network = CLASSIFIER, decision: str = "threshold") -> DataFrame:
    """One row: ``error_in`` on the training rows and ``error_out`` on others, with the sizes of both and of the network."""
    def measured(df: DataFrame, suffix: str) -> DataFrame:
        error = evaluate(df, weights, group, "error", n_inputs, network, decision=decision)
        return error.select(F.col("error").alias(f"error_{suffix}")).join(df.agg(F.count("*").alias(f"rows_{suffix}")))

    return measured(inside, "in").join(measured(outside, "out")).select(  # single rows
        "error_in", "error_out", "rows_in", "rows_out", F.lit(n_inputs).alias("n_inputs"),
        F.lit(network.width(n_inputs)).alias("n_hidden"),
    )
