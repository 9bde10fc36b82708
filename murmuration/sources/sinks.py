"""Writers for curves, predictions, weights and run records.

Tables are partitioned parquet.  The text forms keep the line layout of the printed reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.calendar import hour_label, run_stamp
from murmuration.functions.scalar import fixed16


def write_curve(curve: DataFrame, path: str, mode: str = "overwrite") -> None:
    curve.write.mode(mode).parquet(path)


def write_curve_text(curve: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One value per line, sixteen decimals, in generation order; one folder per run and group."""
    keys = [c for c in curve.columns if c not in ("iter", "best_fitness")]
    (
        curve.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, "iter")
        .select(*keys, fixed16(F.col("best_fitness")).alias("value"))
        .write.mode(mode).partitionBy(*keys).text(path)
    )


def write_predictions(predictions: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Predictions with the time of the run, in one folder per value of ``by``."""
    predictions.withColumn("run_ts", run_stamp()).write.mode(mode).partitionBy(*by).parquet(path)


def prediction_lines(predictions: DataFrame, hour: str = "grp", separator: str = " ", run_ts: bool = False) -> DataFrame:
    """The report as lines: per hour one label line, then ``real predicted`` pairs by ``row_id``.

    With ``run_ts`` the first line is the date and time of the run (hour -1).  Every line carries its sort key, so the caller may write it range-partitioned.
    """
    pairs = predictions.select(
        F.col(hour).alias("hour"),
        F.lit(1).alias("part"),
        F.col("row_id"),
        F.concat_ws(separator, fixed16(F.col("real")), fixed16(F.col("predicted"))).alias("line"),
    )
    labels = predictions.select(F.col(hour).alias("hour")).distinct().select(
        "hour", F.lit(0).alias("part"), F.lit(None).cast("long").alias("row_id"), hour_label(F.col("hour")).alias("line")
    )
    lines = labels.unionByName(pairs)
    if not run_ts:
        return lines
    kind = lines.schema["hour"].dataType
    head = predictions.sparkSession.range(1).select(
        F.lit(-1).cast(kind).alias("hour"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("row_id"),
        run_stamp().alias("line"),
    )
    return head.unionByName(lines)


def write_prediction_report(predictions: DataFrame, path: str, hour: str = "grp", separator: str = " ",
                            mode: str = "overwrite") -> None:
    """The report as text files whose names sort in report order; the time of the run comes first."""
    (
        prediction_lines(predictions, hour, separator, run_ts=True)
        .repartitionByRange("hour", "part", "row_id")
        .sortWithinPartitions("hour", "part", "row_id")
        .select("line")
        .write.mode(mode).text(path)
    )


def write_class_results(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """``real,prediction`` lines of a classification run, appended."""
    predictions.select(
        F.concat_ws(",", F.col("real").cast("string"), F.col("predicted").cast("string")).alias("line")
    ).write.mode(mode).text(path)


def write_weights(weights: DataFrame, path: str, mode: str = "append") -> None:
    weights.write.mode(mode).parquet(path)


def weight_lines(weights: DataFrame, position: str = "pos") -> DataFrame:
    """One comma-separated line of weights per group."""
    keys = [c for c in weights.columns if c not in (position, "fit")]
    line = F.concat_ws(", ", F.transform(F.col(position), lambda w: w.cast("string")))
    return weights.select(*keys, line.alias("line"))


def write_weights_text(weights: DataFrame, path: str, mode: str = "append") -> None:
    lines = weight_lines(weights)
    keys = [c for c in lines.columns if c != "line"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.mode(mode).text(path)


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    runs.write.mode(mode).parquet(path)


def write_runs_text(runs: DataFrame, path: str, mode: str = "append") -> None:
    """``iterations, particles, rows, value`` lines, one folder per metric."""
    line = F.concat_ws(", ", *[F.col(c).cast("string") for c in ("iters", "parts", "rows", "value")])
    runs.select("metric", line.alias("line")).write.mode(mode).partitionBy("metric").text(path)
