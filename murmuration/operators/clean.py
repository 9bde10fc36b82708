"""Row filters, label decoding, validation and ordered limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTED_AT_ONCE = 100_000  # keys that one task sorts
RANGES = 64  # a fixed number, which adaptive execution does not merge again


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows in which every listed text cell is present and non-empty after trimming."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    filled = [F.col(c).isNotNull() & (F.trim(F.col(c)) != F.lit("")) for c in names]
    return df.where(reduce(lambda a, b: a & b, filled, F.lit(True)))


def decode_label(label: Column) -> Column:
    """``"0"`` to 0.0 and ``"1"`` to 1.0; any other value stops the job."""
    text = label.cast("string")
    bad = F.raise_error(F.concat(F.lit("not a valid label: "), F.coalesce(text, F.lit("null"))))
    return F.when(text == "0", F.lit(0.0)).when(text == "1", F.lit(1.0)).otherwise(bad.cast("double"))


def leading_features(df: DataFrame, n: int) -> tuple[Column, Column]:
    """The first ``n`` columns as a feature array and the column after them as the label."""
    names = df.columns
    if len(names) <= n:
        raise ValueError(f"expected more than {n} columns, found {len(names)}")
    return F.array(*[F.col(c).cast("double") for c in names[:n]]), F.col(names[n])


@dataclass(frozen=True)
class Cut:
    """The place of the ``n``-th row: its value, the hash of its cells, and how many rows stand before and there."""

    value: object
    tie: int
    before: int
    there: int


def _tie(df: DataFrame) -> Column:
    """Decides between rows of equal value: a hash of all cells and of which of them are null."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    return F.xxhash64(*plain, *[F.col(c).isNull() for c in plain])


def find_cut(df: DataFrame, n: int, order: str) -> Cut | None:
    """The ``n``-th row of ``df`` by ``order`` (nulls first), or None if there are not so many.

    Only the sort key moves.  It is cut into ranges; the range with the wanted row is cut again until one task can
    sort what is left.  Counts and ends of the ranges are all that comes back.  Any type that can be ordered will do.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    keys = df.select(F.struct(F.col(order).alias("value"), _tie(df).alias("tie")).alias("key"))
    part, before = keys, 0
    total = part.count()
    if total < n:
        return None
    while total > SORTED_AT_ONCE:
        ranges = (
            part.repartitionByRange(RANGES, "key").groupBy(F.spark_partition_id())
            .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
        )
        for r in ranges:
            if before + r.n >= n:
                break
            before += r.n
        if r.low == r.high:
            return Cut(r.low[0], r.low[1], before, r.n)
        if r.n == total:  # one value dominates: take out the smallest one
            first = part.where(_compare(r.low, "=")).count()
            if before + first >= n:
                return Cut(r.low[0], r.low[1], before, first)
            part, before, total = part.where(_compare(r.low, ">")), before + first, total - first
        else:
            part, total = part.where(_compare(r.low, ">=") & _compare(r.high, "<=")), r.n
    key = part.orderBy("key").limit(n - before).agg(F.max("key")).first()[0]
    counts = part.agg(F.count_if(_compare(key, "<")), F.count_if(_compare(key, "="))).first()
    return Cut(key[0], key[1], before + counts[0], counts[1])


def _compare(key, how: str, value: Column | None = None, tie: Column | None = None) -> Column:
    """``(value, tie) how key`` in the order of ``orderBy``: null is smaller than anything."""
    value = F.col("key.value") if value is None else value
    tie = F.col("key.tie") if tie is None else tie
    at = F.lit(key[1])
    if key[0] is None:
        same, less = value.isNull(), F.lit(False)
    else:
        same, less = value.eqNullSafe(F.lit(key[0])), value.isNull() | (value < F.lit(key[0]))
    ties = {"=": tie == at, ">": tie > at, ">=": tie >= at, "<=": tie <= at, "<": tie < at}[how]
    if how == "=":
        return same & ties
    return (less | (same & ties)) if how in ("<", "<=") else (~less & ~same) | (same & ties)


def up_to(df: DataFrame, cut: Cut, order: str, how: str = "<=") -> Column:
    """True for the rows of ``df`` that stand at or before the cut."""
    return _compare((cut.value, cut.tie), how, F.col(order), _tie(df))


def at_cut(df: DataFrame, cut: Cut, order: str) -> DataFrame:
    """The rows that stand at the cut, numbered from 0 in ``rank``, wherever they are: counts per partition give offsets."""
    equal = df.where(up_to(df, cut, order, "="))
    counts = sorted(equal.groupBy(F.spark_partition_id().alias("part")).count().collect())
    starts, before = [], 0
    for r in counts:
        starts.append((r.part, before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    placed = equal.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    return placed.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("start") + F.col("row")).alias("rank"))


def first_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows by ``order``, nulls first; rows of equal value go by a hash of all their cells.

    The place of the last row is found first (see ``find_cut``, which runs jobs); the result is a filter on it and
    moves no rows.  Of rows that are equal in all cells as many as fit are taken, by their places in the partitions.
    """
    cut = find_cut(df, n, order)
    if cut is None:
        return df
    wanted = up_to(df, cut, order)
    if cut.value is not None:  # this part is pushed into the scan
        wanted = (F.col(order).isNull() | (F.col(order) <= F.lit(cut.value))) & wanted
    if cut.before + cut.there == n:
        return df.where(wanted)
    equal = at_cut(df, cut, order).where(F.col("rank") < n - cut.before).drop("rank")
    return df.where(up_to(df, cut, order, "<")).unionByName(equal)


def dimensions(df: DataFrame, x: str = "x", y: str | None = "y") -> DataFrame:
    """One row: number of rows, narrowest and widest feature array, and null counts."""
    missing_y = F.count_if(F.col(y).isNull()) if y else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(x)).alias("min_width"),
        F.max(F.size(x)).alias("max_width"),
        F.count_if(F.col(x).isNull()).alias("null_x"),
        missing_y.alias("null_y"),
    )
