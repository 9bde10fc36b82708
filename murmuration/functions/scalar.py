"""Activations, clipping and text forms of single numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_EPSILON = 1e-15


def relu(x: Column, nan_to_zero: bool = False) -> Column:
    """``max(0, x)``.  NaN stays NaN unless ``nan_to_zero`` (the "x > 0 else 0" form) is asked for."""
    plain = F.greatest(F.lit(0.0), x)
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(plain) if nan_to_zero else plain


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def threshold(x: Column, at: float = 0.5) -> Column:
    """0.0 below the threshold, 1.0 otherwise; NaN gives 1.0."""
    return F.when(x < F.lit(at), F.lit(0.0)).otherwise(F.lit(1.0))


def clip_probability(p: Column, eps: float = PROBABILITY_EPSILON) -> Column:
    """Away from 0 and 1; an unknown probability stays null, NaN stays NaN."""
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.when(p.isNull() | F.isnan(p), p).otherwise(clipped)


def clamp(x: Column, limit: float) -> Column:
    """Restrict to ``[-limit, limit]``.  Inputs are expected to be finite."""
    return F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), x))


def squared_error(y: Column, predicted: Column) -> Column:
    return F.pow(y - predicted, F.lit(2.0))


def activate(x: Column, kind: str) -> Column:
    if kind == "tanh":
        return F.tanh(x)
    if kind == "relu":
        return relu(x)
    if kind == "sigmoid":
        return sigmoid(x)
    return x


def fixed16(x: Column) -> Column:
    """Text with sixteen decimals and a decimal point, for files only."""
    return F.format_string("%.16f", x)
