"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from murmuration.sources.scratch import Scratch

Batches = Iterator[pa.RecordBatch]
ROWS_AT_ONCE = 500  # of a batch that are Python objects at the same time


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to add; results win over columns of the input."""
    taken = {name.lower() for name in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def append_columns(df: DataFrame, fields: list[T.StructField], worker: Callable[[Batches], Batches]) -> DataFrame:
    """All columns of ``df`` and those that ``worker`` appends to its Arrow batches, without a shuffle."""
    def in_slices(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield batch.slice(start, ROWS_AT_ONCE)

    def run(batches: Batches) -> Batches:
        yield from worker(in_slices(batches))
        pa.default_memory_pool().release_unused()  # the process serves other tasks

    kept = without(df, [f.name for f in fields])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def appended(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], names=[*batch.schema.names, *arrays])


def strings(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts as UTF-8 bytes."""
    array = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


def stored(df: DataFrame, scratch: Scratch, name: str, rows_at_once: int | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, which cuts its lineage and survives lost executors.

    Writers and readers hold a group of rows in memory; of large rows that is ``rows_at_once``.
    """
    writer = df.write.option("compression", "zstd")
    if rows_at_once is not None:
        writer = writer.option("parquet.block.row.count.limit", rows_at_once)
    writer.parquet(scratch.path(name))
    return df.sparkSession.read.schema(df.schema).parquet(scratch.path(name))


@contextmanager
def rows_of_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most ``rows`` rows at once to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
