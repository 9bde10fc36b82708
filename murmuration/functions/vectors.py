"""Feature arrays: one-hot blocks, concatenation, slices and dot products."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(value: Column, vocabulary: Iterable) -> Column:
    """Indicators against a vocabulary known when the plan is written.

    A flat ``array(...)`` of comparisons, so it stays inside whole-stage code generation.
    """
    return F.array(*[F.when(value == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)) for v in vocabulary])


def one_hot_against(value: Column, vocabulary: Column) -> Column:
    """Indicators against an array column, for vocabularies read from the data.

    Built from repeated zeros around a one, without a lambda, so the array may be a scalar subquery.
    A value outside the vocabulary gives only zeros.
    """
    size = F.size(vocabulary)
    place = F.coalesce(F.array_position(vocabulary, value), F.lit(0)).cast("int")
    zeros = F.lit(0.0)
    hot = F.concat(F.array_repeat(zeros, place - 1), F.array(F.lit(1.0)), F.array_repeat(zeros, size - place))
    return F.when(place > 0, hot).otherwise(F.array_repeat(zeros, size))


def append(x: Column, value: Column) -> Column:
    return F.concat(x, F.array(value.cast("double")))


def cut(x: Column, start: int, length: int) -> Column:
    """``length`` entries from the zero-based position ``start``."""
    return F.slice(x, start + 1, length)


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
