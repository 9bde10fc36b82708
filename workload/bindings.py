"""Roles of the test tables: a demand series, a labelled vector table, a mixed table, stored label pairs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.draws import drawn_vector, lattice
from murmuration.network import Network
from murmuration.plans.features import calendar_features

DEMAND_INPUTS = 14
VECTOR_INPUTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, grp, x, y``: one row per event, grouped by clock hour, fourteen features."""
    events = table(spark, sf_dir, "events")
    programmed = F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)
    return events.select(
        F.col("event_id").alias("row_id"),
        F.hour("ts").alias("grp"),
        calendar_features(F.col("ts"), programmed).alias("x"),
        (F.col("value") / F.lit(100.0)).alias("y"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, grp, x, y``: one row per embedding, labels below five are the positive class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.lit(0).alias("grp"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") < 5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("y"),
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the priority of their order; the four keys identify a line."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn(
        "line",  # the four keys as one number, in their order
        (F.col("l_orderkey").cast("decimal(38,0)") * F.lit(Decimal(10**22)) + F.col("l_partkey") * F.lit(Decimal(10**12))
         + F.col("l_suppkey") * F.lit(10**2) + F.col("l_linenumber")).cast("decimal(38,0)"),
    )


def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, real, predicted`` from the stored labels."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("double").alias("real"),
        F.col("toxic").cast("double").alias("predicted"),
    )


def lattice_weights(data: DataFrame, network: Network, n_inputs: int, limit: float) -> DataFrame:
    """One reproducible model per group of ``data``."""
    size = network.n_weights(n_inputs)
    return data.select("grp").distinct().withColumn(
        "pos", drawn_vector(lattice, 0, [F.col("grp")], F.lit(0), size, limit)
    )
