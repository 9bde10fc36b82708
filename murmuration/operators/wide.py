"""Wide vocabularies: distinct values numbered by ranges, and sparse feature vectors over them.

Nothing here is as long as the vocabulary: not a cell, not a task, not the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.operators.meeting import BROADCAST_BYTES, MOST_SHARDED
from murmuration.sources.scratch import Scratch

_PLACE = (1 << 33) - 1
SPARSE = "struct<size bigint, indices array<bigint>, values array<double>>"


def number_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str = "numbered") -> DataFrame:
    """``df`` with ``number``: its place, from 0, in the order of the columns ``order`` (nulls first).

    Ranges of the order are stored once with the place inside each; the numbers of rows of the ranges before, one
    row per range, are added when the table is read.  The range is a column of the stored table, so any
    later reading gives the same numbers.  Rows that are equal in ``order`` are numbered in any order, and rows that
    are equal in all of it stay in one range: let ``order`` tell rows apart where there may be many.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_place")
    )
    table = scratch.store(ranged, name)
    counts = sorted(table.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row per partition
    starts, before = [], 0
    for r in counts:
        starts.append((r[0], before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return table.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_start") + F.col("_place")).alias("number"))


def number_values(df: DataFrame, column: str, order: str, scratch: Scratch | None = None,
                  name: str = "values") -> DataFrame:
    """``value, number, n``: distinct values of ``column``, numbered from 0 by first appearance, and how many rows have each.

    Values that appear first at the same ``order`` are numbered by themselves.  Null is no value.
    """
    scratch = scratch or Scratch(df.sparkSession)
    known = df.where(F.col(column).isNotNull())
    seen = known.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))
    return number_rows(seen, ["first_at", "value"], scratch, name).select("value", "number", "n")


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() != "map"])


def look_up(df: DataFrame, column: str, numbered: DataFrame, output: str = "number",
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the number of its value; null where the value is null or not ``numbered``.

    The vocabulary is broadcast while its measured size is within ``broadcast_bytes``.  Beyond it both sides are
    shuffled by (value, shard): values with more than a 4,096th of all rows, which are fewer than 4,096, are split
    by a hash of the row, and their numbers copied to each shard.
    """
    if output in df.columns:
        raise ValueError(f"there is a column {output} already")
    text_bytes = F.octet_length("value") if isinstance(numbered.schema["value"].dataType, T.StringType) else F.lit(16)
    size, rows = numbered.agg(F.sum(text_bytes + F.lit(32)), F.sum("n")).first()
    entries = numbered.select(F.col("value").alias("_value"), F.col("number").alias(output), "n")
    if (size or 0) <= broadcast_bytes:
        return df.join(F.broadcast(entries.drop("n")), F.col(column) == F.col("_value"), "left").drop("_value")
    share = max(1, rows // MOST_SHARDED)
    shards = F.ceil(F.col("n") / F.lit(share)).cast("int")
    hot = entries.where(F.col("n") > share).select(F.col("_value").alias("_hot"), shards.alias("_shards"))
    copies = entries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, shards).otherwise(1) - 1)))
    spread = F.coalesce(F.col("_shards"), F.lit(1))
    dealt = df.join(F.broadcast(hot), F.col(column) == F.col("_hot"), "left").withColumn(
        # nulls meet nothing and would gather in one task: they are spread too
        "_at", F.when(F.col(column).isNull(), F.pmod(_row_hash(df), F.lit(MOST_SHARDED))).otherwise(F.pmod(_row_hash(df), spread)).cast("int")
    )
    met = dealt.join(copies.drop("n").hint("merge"), (F.col(column) == F.col("_value")) & (F.col("_at") == F.col("_shard")), "left")
    return met.select(*df.columns, output)


def sparse_one_hot(index: Column, size: int | Column) -> Column:
    """A one at ``index`` in a vector of ``size`` entries; an unknown index gives only zeros."""
    size = size if isinstance(size, Column) else F.lit(size)
    none = index.isNull()
    return F.struct(
        size.cast("long").alias("size"),
        F.when(none, F.array().cast("array<bigint>")).otherwise(F.array(index.cast("long"))).alias("indices"),
        F.when(none, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("values"),
    ).cast(SPARSE)


def sparse_concat(*blocks: Column) -> Column:
    """Sparse vectors one after the other."""
    def moved(block: Column, start: Column) -> Column:
        return F.transform(block["indices"], lambda i: i + start)

    indices, values, size = [], [], F.lit(0).cast("long")
    for block in blocks:
        indices.append(moved(block, size))
        values.append(block["values"])
        size = size + block["size"]
    return F.struct(size.alias("size"), F.concat(*indices).alias("indices"), F.concat(*values).alias("values")).cast(SPARSE)


def sparse_numbers(numbers: list[Column]) -> Column:
    """Numbers as a sparse vector that spells out all of them, unknown ones too."""
    places = F.array(*[F.lit(i).cast("long") for i in range(len(numbers))])
    return F.struct(F.lit(len(numbers)).cast("long").alias("size"), places.alias("indices"),
                    F.array(*[n.cast("double") for n in numbers]).alias("values")).cast(SPARSE)


def dense(x: Column) -> Column:
    """All entries of a sparse vector; for narrow ones."""
    places = F.sequence(F.lit(0).cast("long"), x["size"] - 1)
    spelled = F.transform(places, lambda i: F.coalesce(F.array_position(x["indices"], i), F.lit(0)).cast("int"))
    entries = F.transform(spelled, lambda at: F.when(at > 0, F.get(x["values"], at - 1)).otherwise(F.lit(0.0)))
    return F.when(x["size"] > 0, entries).otherwise(F.array().cast("array<double>"))


def assemble_with_width(df: DataFrame, categorical: list[str], numeric: list[str], order: str, output: str = "x",
                        scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``assemble_sparse`` and the width of its vectors, which the vocabularies tell without another pass over the rows."""
    scratch = scratch or Scratch(df.sparkSession)
    coded, blocks, width = df, [], len(numeric)
    for i, column in enumerate(categorical):
        numbered = number_values(df, column, order, scratch, f"values-{i}")
        size = numbered.count()
        coded = look_up(coded, column, numbered, f"_index{i}", broadcast_bytes)
        blocks.append(sparse_one_hot(F.col(f"_index{i}"), size))
        width += size
    if numeric:
        blocks.append(sparse_numbers([F.col(c) for c in numeric]))
    return coded.select(*[c for c in df.columns if c != output], sparse_concat(*blocks).alias(output)), width


def assemble_sparse(df: DataFrame, categorical: list[str], numeric: list[str], order: str, output: str = "x",
                    scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add one sparse column: one-hot blocks of ``categorical`` by first appearance, then ``numeric`` as doubles.

    As ``encode.assemble_features``, for vocabularies of any width.  Null categories give only zeros, null numbers
    stay null, an empty table has blocks of no width.  Runs jobs: vocabularies are stored below the scratch folder.
    """
    return assemble_with_width(df, categorical, numeric, order, output, scratch, broadcast_bytes)[0]


def _dot(shared, n_keys: int):
    """Scores of batches ``*keys, entries``; ``shared`` holds the places that have a weight, in order, and the weights."""
    def work(batches):
        index, weight = shared.value
        for batch in batches:
            entries = batch.column(n_keys)
            lengths = pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False)
            flat = entries.flatten()
            places, values = flat.field("i"), flat.field("v")
            known = places.is_valid().to_numpy(zero_copy_only=False) & values.is_valid().to_numpy(zero_copy_only=False)
            places = pc.fill_null(places, 0).to_numpy(zero_copy_only=False)
            terms = np.zeros(len(places))
            if len(index):
                at = np.minimum(np.searchsorted(index, places), len(index) - 1)
                known &= index[at] == places
                terms[known] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)[known] * weight[at[known]]
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            scores = pa.array(np.bincount(rows, weights=terms, minlength=batch.num_rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], scores], names=[*batch.schema.names[:n_keys], "score"]
            )

    return work


def sparse_scores(df: DataFrame, keys: list[str], x: str, weights: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``*keys, score``, one row per row of ``df``: dot products of sparse vectors with the table ``index, weight``.

    Entries without a weight count as zero, vectors without entries score zero; ``keys`` may repeat or be null.  Weights of
    at most ``broadcast_bytes`` (16 bytes each) are in the tasks, and rows are scored where they are.  Beyond it the
    rows are stored with a number, and their entries find their weights as in ``look_up``, so an index that a third
    of all rows has is split.
    """
    entries = F.arrays_zip(F.col(f"{x}.indices").alias("i"), F.col(f"{x}.values").alias("v"))
    known = weights.where(F.col("index").isNotNull()).groupBy(F.col("index").cast("long").alias("index")).agg(
        F.sum(F.col("weight").cast("double")).alias("weight")).where(F.col("weight").isNotNull())
    if 16 * known.count() <= broadcast_bytes:
        held = known.toArrow()
        index, weight = (held.column(c).to_numpy() for c in ("index", "weight"))
        order = np.argsort(index)
        shared = df.sparkSession.sparkContext.broadcast((index[order], weight[order]))
        rows = df.select(*keys, entries.alias("_entries"))
        return rows.mapInArrow(_dot(shared, len(keys)), T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    # Numbers of rows are read from the stored table, so a task that runs again finds the same ones.
    numbered = Scratch(df.sparkSession).store(df.select(*keys, entries.alias("_e"), F.monotonically_increasing_id().alias("_row")), "rows")
    terms = numbered.select(*keys, "_row", F.explode_outer("_e").alias("e")).select(
        *keys, "_row", F.col("e.i").alias("_i"), F.col("e.v").alias("_v"))
    used = terms.where(F.col("_i").isNotNull()).groupBy(F.col("_i").alias("value")).agg(F.count("*").alias("n"))
    named = known.select(F.col("index").alias("value"), F.col("weight").alias("number")).join(used, "value")
    met = look_up(terms, "_i", named, "_weight", broadcast_bytes)
    scored = met.groupBy("_row", *keys).agg(F.coalesce(F.sum(F.col("_v") * F.col("_weight")), F.lit(0.0)).alias("score"))
    return scored.select(*keys, "score")
