"""Packing of training rows into numpy-ready blocks.

A block holds about 16 MB of one group's rows as two binary columns (features and targets).  Packing
happens once, inside the partitions the rows already have: nothing is shuffled, and a group that holds
most of the table is simply many blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.operators.meeting import hot_groups, shard_blocks

BLOCK_BYTES = 16 << 20
LEAST_ROWS = 1024  # of a block, where a task has less than a block's bytes of a group
_PIECES = 8
_PARTITION_BYTES = 128 << 20
_BUFFERED_VALUES = 1 << 22  # doubles waiting in one task (32 MB)
_SENT_BYTES = 4 << 20  # of blocks that leave a task at once


def _matrix(column, n):
    """(n, d) doubles of a list column; stops on nulls and on rows of different width."""
    if column.null_count:
        raise ValueError("null feature array")
    values = column.flatten()
    if values.null_count:
        raise ValueError("null inside a feature array")
    widths = np.diff(column.offsets.to_numpy())
    if n and not (widths == widths[0]).all():
        raise ValueError(f"feature arrays differ in width: {widths.min()} to {widths.max()}")
    matrix = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1)
    if np.isnan(matrix).any():
        raise ValueError("NaN inside a feature array")
    return matrix


def block_rows(n_inputs: int) -> int:
    """Rows of a full block: the particles that travel beside it are a small part of its bytes."""
    return max(LEAST_ROWS, BLOCK_BYTES // (8 * (n_inputs + 1)))


def _packer(keys, rows, with_ids):
    def pack(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        waiting, schema, buffered = {}, None, 0

        def packed(made):
            columns = list(zip(*made))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

        def flush(groups, pieces=1):
            """The waiting rows of ``groups``, a few blocks at a time."""
            nonlocal serial
            made, held = [], 0
            for key in groups:
                x, y, tags = (np.concatenate(part) if part else None for part in waiting.pop(key))
                full = rows or block_rows(x.shape[1])
                size = full if rows or len(y) >= full else min(full, max(LEAST_ROWS, -(-len(y) // pieces)))
                for i in range(0, len(y), size):
                    piece = x[i : i + size]
                    row = (*key, serial, len(piece), piece.shape[1], piece.tobytes(), y[i : i + size].tobytes())
                    made.append((*row, tags[i : i + size].tobytes()) if with_ids else row)
                    serial += 1
                    held += piece.nbytes
                    if held >= _SENT_BYTES:
                        yield packed(made)
                        made, held = [], 0
            if made:
                yield packed(made)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if schema is None:
                fields = [batch.schema.field(k) for k in keys] + [
                    pa.field("block", pa.int64()), pa.field("n", pa.int32()), pa.field("d", pa.int32()),
                    pa.field("bx", pa.binary()), pa.field("by", pa.binary()),
                ] + ([pa.field("bid", pa.binary())] if with_ids else [])
                schema = pa.schema(fields)
            x = _matrix(batch.column("x"), n)
            target = batch.column("y")
            if target.null_count:
                raise ValueError("null target")
            y = target.cast(pa.float64()).to_numpy(zero_copy_only=False)
            ids = batch.column("row_id").to_numpy(zero_copy_only=False) if with_ids else None
            frame = pa.Table.from_batches([batch.select(list(keys))]).to_pandas()
            for index in frame.groupby(list(keys), sort=False, dropna=False).indices.values():
                key = tuple(batch.column(k)[int(index[0])].as_py() for k in keys)
                slot = waiting.setdefault(key, ([], [], []))
                slot[0].append(x[index])
                slot[1].append(y[index])
                if with_ids:
                    slot[2].append(ids[index])
                buffered += x[index].size
            if buffered > _BUFFERED_VALUES:
                yield from flush(list(waiting))
                buffered = 0
            else:
                full = [k for k, slot in waiting.items()
                        if sum(map(len, slot[1])) >= (rows or block_rows(x.shape[1]))]
                if full:
                    buffered -= sum(a.size for k in full for a in waiting[k][0])
                    yield from flush(full)
        if waiting:  # a small table is cut finer, so that its blocks can be spread
            yield from flush(list(waiting), _PIECES)

    return pack


def pack_blocks(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", row_id: str | None = None,
                rows: int | None = None) -> DataFrame:
    """Columns ``*keys, block, n, d, bx, by[, bid]``; ``block`` numbers the blocks of the table.

    Blocks have ``rows`` rows, or as many as the width of the rows suggests (see ``block_rows``).
    """
    columns = [F.col(k) for k in keys] + [F.col(x).alias("x"), F.col(y).cast("double").alias("y")]
    if row_id:
        columns.append(F.col(row_id).cast("long").alias("row_id"))
    source = df.select(*columns)
    fields = [source.schema[k] for k in keys] + [
        T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("d", T.IntegerType()), T.StructField("bx", T.BinaryType()),
        T.StructField("by", T.BinaryType()),
    ] + ([T.StructField("bid", T.BinaryType())] if row_id else [])
    return source.mapInArrow(_packer(tuple(keys), rows, bool(row_id)), T.StructType(fields))


def cluster_rows(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Bring rows of a group together before packing, for tables with very many small groups.

    Ranges over (group, row) split a big group over several partitions.
    """
    return df.repartitionByRange(*keys, row_id).sortWithinPartitions(*keys)


class PackedTable:
    """Blocks kept for repeated passes, with the facts the passes need."""

    def __init__(self, blocks: DataFrame, keys: list[str], storage: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        spark = blocks.sparkSession
        self.keys = keys
        self.hot = None
        self.storage = storage
        self.blocks = blocks.persist(storage)
        facts = self._facts()
        cores = spark.sparkContext.defaultParallelism
        if facts.parts < cores and facts.blocks > facts.parts:
            # Few input files: spread the packed blocks once so that every core has work.
            spread = self.blocks.repartition(cores).persist(storage)
            spread.count()
            self.blocks.unpersist()
            self.blocks = spread
        if not facts.n_rows:
            self.close()
            raise ValueError("the table is empty")
        if facts.min_d != facts.max_d or not facts.min_d:
            self.close()
            raise ValueError(f"feature arrays differ in width: {facts.min_d} to {facts.max_d}")
        if facts.no_group:
            self.close()
            raise ValueError(f"{facts.no_group} rows have a null group")
        self.n_rows, self.n_blocks, self.n_inputs = facts.n_rows, facts.blocks, facts.min_d
        self.n_groups = self.groups().count()

    def _facts(self):
        return self.blocks.agg(
            F.sum("n").alias("n_rows"), F.count("n").alias("blocks"), F.min("d").alias("min_d"),
            F.max("d").alias("max_d"), F.sum(self._ungrouped()).alias("no_group"), F.countDistinct(F.shiftright("block", 33)).alias("parts"),
        ).first()

    def _ungrouped(self):
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        return F.when(missing, F.col("n")).otherwise(0)

    def groups(self) -> DataFrame:
        """The groups with their row and block counts."""
        return self.blocks.groupBy(*self.keys).agg(
            F.sum("n").cast("long").alias("n_rows"), F.count("n").alias("n_blocks")
        )

    def partition_for_joins(self) -> None:
        """Partition the blocks once by (group, shard), for swarms too big to broadcast.

        Later passes shuffle only the particles: the kept blocks already lie where the join needs them, in its order.
        """
        if self.hot is not None:
            return
        spark = self.blocks.sparkSession
        hot = hot_groups(self.blocks, self.keys, self.n_blocks).persist(self.storage)
        size = 8 * self.n_rows * (self.n_inputs + 1)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _PARTITION_BYTES))
        where = [*self.keys, "shard"]
        placed = (
            shard_blocks(self.blocks, hot, self.keys).repartition(parts, *where).sortWithinPartitions(*where)
            .persist(self.storage)
        )
        placed.count()
        self.blocks.unpersist()
        self.blocks, self.hot = placed, hot

    def close(self) -> None:
        if self.hot is not None:
            self.hot.unpersist()
        self.blocks.unpersist()
