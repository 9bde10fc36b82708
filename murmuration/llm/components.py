"""Connected components by alternating stars; every step is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.sources.scratch import Scratch


def _marks(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Hang the neighbours of every node below its smallest one.  The smallest ones are stored first, so that the
    join has an exchange on both sides and Spark splits a node with very many neighbours."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.store(
        pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select("u", "m"), f"{name}-least"
    )
    joined = pairs.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return scratch.store(moved.where(F.col("a") != F.col("b")).distinct(), name)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of the undirected ``a, b``; the root is the smallest node of its component.

    The number of rounds grows with the logarithm of the longest path.  No component is ever collected.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current = scratch.store(ordered, "links")
    before, after, k = None, _marks(current), 0
    while before != after:
        wide = _star(current, scratch, f"large-{k}", large=True)
        current = _star(wide, scratch, f"small-{k}", large=False)
        before, after, k = after, _marks(current), k + 1
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
