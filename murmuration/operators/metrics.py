"""Metrics of stored predictions: one row per group, or one row for the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.scalar import clip_probability, squared_error
from murmuration.operators import ranking


def _over(df: DataFrame, by: list[str] | None):
    return df.groupBy(*by) if by else df.groupBy()


def _undefined(value: Column, empty: str) -> Column:
    """A ratio without denominator is null, or NaN with ``empty='nan'``."""
    if empty == "nan":
        return F.coalesce(value, F.lit(float("nan")))
    return value


def mse(df: DataFrame, y: str = "real", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return _over(df, by).agg(F.avg(squared_error(F.col(y), F.col(predicted))).alias("mse"))


def macro_mse(df: DataFrame, group: list[str], y: str = "real", predicted: str = "predicted",
              by: list[str] | None = None) -> DataFrame:
    """Unweighted mean over the groups of the mean squared error of each."""
    per_group = mse(df, y, predicted, [*(by or []), *group])
    return _over(per_group, by).agg(F.avg("mse").alias("macro_mse"))


def accuracy(df: DataFrame, y: str = "real", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return _over(df, by).agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"))


def error_rate(df: DataFrame, y: str = "real", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return _over(df, by).agg(
        (F.lit(1.0) - F.avg((F.col(y) == F.col(predicted)).cast("double"))).alias("error")
    )


def cross_entropy(df: DataFrame, y: str = "real", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Binary cross-entropy, summed over the rows, with probabilities clipped away from 0 and 1."""
    p, t = clip_probability(F.col(score)), F.col(y)
    term = t * F.ln(p) + (F.lit(1.0) - t) * F.ln(F.lit(1.0) - p)
    return _over(df, by).agg((-F.sum(term)).alias("bce"))


def class_counts(df: DataFrame, y: str = "real", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return _over(df, by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(y) == 1).alias("real_ones"),
        F.count_if(F.col(predicted) == 1).alias("predicted_ones"),
    )


def f1(df: DataFrame, y: str = "real", predicted: str = "predicted", by: list[str] | None = None,
       empty: str = "null") -> DataFrame:
    t, p = F.col(y), F.col(predicted)
    counts = _over(df, by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
    )
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    value = F.try_divide(F.lit(2.0) * (precision * recall), precision + recall)
    return counts.withColumn("f1", _undefined(value, empty))


def auc(df: DataFrame, y: str = "real", score: str = "score", by: list[str] | None = None,
        mode: str = "rank") -> DataFrame:
    """Area under the ROC curve.

    ``mode='literal'`` reproduces a running form that adds one half per positive whatever the ranking,
    which always comes to ``1 / (2 * negatives)``.
    """
    if mode == "rank":
        return ranking.auc(df, y, score, by)
    if mode != "literal":
        raise ValueError("mode must be 'rank' or 'literal'")
    counts = _over(df, by).agg(
        F.count_if((F.col(y) == 1) & F.col(score).isNotNull()).alias("positives"),
        F.count_if((F.col(y) != 1) & F.col(score).isNotNull()).alias("negatives"),
    )
    half_each = F.col("positives") * F.lit(0.5)
    return counts.withColumn(
        "auc", F.try_divide(half_each, F.col("positives").cast("double") * F.col("negatives"))
    )


def summary(df: DataFrame, n_inputs: int, n_hidden: int, y: str = "real", predicted: str = "predicted") -> DataFrame:
    """One row: rows, real and predicted ones, error rate, features and hidden neurons."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(y) == 1).alias("real_ones"),
        F.count_if(F.col(predicted) == 1).alias("predicted_ones"),
        (F.lit(1.0) - F.avg((F.col(y) == F.col(predicted)).cast("double"))).alias("error"),
        F.lit(n_inputs).alias("n_inputs"),
        F.lit(n_hidden).alias("n_hidden"),
    )
