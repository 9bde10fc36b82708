"""Joining blocks of rows with the models or particles of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 << 20
MOST_SHARDED = 4096


def hot_groups(blocks: DataFrame, on: list[str], n_blocks: int) -> DataFrame:
    """Groups with more than their share of blocks, and into how many shards each is split.

    The share is ``n_blocks / MOST_SHARDED``, so there are fewer than ``MOST_SHARDED`` such groups
    whatever the data, and none of their shards is larger than the share.
    """
    share = max(1, n_blocks // MOST_SHARDED)
    if n_blocks < MOST_SHARDED:
        share = max(share, n_blocks // 64)
    return (
        blocks.groupBy(*on).agg(F.count(F.lit(1)).alias("in_group")).where(F.col("in_group") > share)
        .select(*on, F.ceil(F.col("in_group") / F.lit(share)).cast("int").alias("shards"))
    )


def shard_blocks(blocks: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Add ``shard``: zero for most groups, spread evenly for hot ones."""
    shards = F.coalesce(F.col("shards"), F.lit(1))
    return (
        blocks.join(F.broadcast(hot), on, "left")
        .withColumn("shard", F.pmod(F.xxhash64("block"), shards).cast("int"))
        .drop("shards")
    )


def copy_to_shards(side: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """One copy of the small side per shard of its group."""
    shards = F.coalesce(F.col("shards"), F.lit(1))
    return (
        side.join(F.broadcast(hot), on, "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
        .drop("shards")
    )


def meet(blocks: DataFrame, side: DataFrame, on: list[str], side_bytes: int, hot: DataFrame | None = None,
         how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join blocks with the small side of their group.

    The side is broadcast only while its known size is within ``broadcast_bytes``.  Beyond it both are
    partitioned by (group, shard); blocks that already carry ``shard`` and were partitioned by it stay
    in place.
    """
    if side_bytes <= broadcast_bytes:
        return blocks.join(F.broadcast(side), on, how)
    if hot is None:
        hot = hot_groups(blocks, on, blocks.count())
    if "shard" not in blocks.columns:
        blocks = shard_blocks(blocks, hot, on)
    return blocks.join(copy_to_shards(side, hot, on).hint("merge"), [*on, "shard"], how)
