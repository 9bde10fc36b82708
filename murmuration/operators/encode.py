"""Vocabularies read from the data, and feature assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.vectors import one_hot_against


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the position where each appears first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first_at"))


def _words(listed: Column, max_size: int | None, what: str) -> Column:
    """The values of (first_at, value) pairs in order; more than ``max_size`` stop the job."""
    words = F.transform(F.array_sort(listed), lambda s: s["value"])
    if max_size is None:
        return words
    too_wide = F.raise_error(F.lit(f"{what} has more than {max_size} distinct values"))
    return F.when(F.size(listed) <= max_size, words).otherwise(too_wide)


def vocabulary(df: DataFrame, column: str, order: str, max_size: int | None = None) -> DataFrame:
    """One row with the distinct values as an array in order of first appearance.

    The array is as long as the one-hot block is wide.  ``max_size`` guards against columns that are not categories.
    """
    seen = first_seen(df, column, order).agg(F.collect_list(F.struct("first_at", "value")).alias("listed"))
    return seen.select(_words(F.col("listed"), max_size, f"column {column}").alias("words"))


def one_hot_first_seen(df: DataFrame, column: str, order: str, max_size: int | None = None) -> Column:
    """Indicators of ``column`` in order of first appearance in ``df``.

    The vocabulary enters the plan as a scalar subquery: it is computed once and there is no join.
    """
    return one_hot_against(F.col(column), vocabulary(df, column, order, max_size).scalar())


def vocabularies(df: DataFrame, columns: list[str], order: str, max_size: int | None = None) -> DataFrame:
    """One row with one array per column, as ``vocabulary`` gives them, from a single pass over ``df``.

    With a number as ``order`` the cells are combined by hashing, without a sort.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)
    ])
    seen = (
        df.select(F.col(order).alias("first_at"), F.explode(cells).alias("cell"))
        .groupBy("cell.i", "cell.value").agg(F.min("first_at").alias("first_at"))
    )
    listed = seen.groupBy().agg(*[
        F.collect_list(F.when(F.col("i") == i, F.struct("first_at", "value"))).alias(f"w{i}")
        for i in range(len(columns))
    ])
    return listed.select(*[_words(F.col(f"w{i}"), max_size, f"column {c}").alias(c) for i, c in enumerate(columns)])


def assemble_features(df: DataFrame, categorical: list[str], numeric: list[str], order: str,
                      output: str = "x", max_size: int | None = None) -> DataFrame:
    """Add one array column: the one-hot blocks of ``categorical``, then ``numeric`` as doubles.

    Categories are compared as text.
    """
    words = vocabularies(df, categorical, order, max_size).select(F.struct(*categorical)).scalar()
    known = F.col("_words")  # a column of its own, so that the subquery enters the plan once
    blocks = [one_hot_against(F.col(c).cast("string"), known[c]) for c in categorical]
    numbers = F.array(*[F.col(c).cast("double") for c in numeric])
    return df.withColumn("_words", words).withColumn(output, F.concat(*blocks, numbers)).drop("_words")
