"""Order statistics without a global window: the area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None,
        counted: bool = False) -> DataFrame:
    """Rank-based AUC with ties counted half: ``*by, positives, negatives, auc``.

    Equal scores collapse to counts first (combined before the shuffle).  The distinct scores are then
    range-partitioned, each range is walked on its own, and one row per range carries the number of
    negatives below it.  With ``counted`` the input already has ``positives`` and ``negatives`` per score.
    Without positives or without negatives the result is null.  Pairs with an unknown side do not count.
    """
    by = by or []
    if not counted:
        df = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
        df = df.select(*by, F.col(score).alias("score"), F.col(y).alias("y")).withColumns({
            "positives": F.when(F.col("y") == 1.0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
            "negatives": F.when(F.col("y") == 1.0, F.lit(0)).otherwise(F.lit(1)).cast("long"),
        })
        score = "score"
    ranked = (
        df.groupBy(*by, score)
        .agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
        .repartitionByRange(*by, score)
        .withColumn("span", F.spark_partition_id())
    )
    below = Window.partitionBy(*by, "span").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        ranked.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
        .groupBy(*by, "span")
        .agg(
            F.sum("p").alias("p"),
            F.sum("n").alias("n"),
            F.sum(F.col("p") * (F.col("below") + F.col("n") / F.lit(2.0))).alias("inner_area"),
        )
    )
    earlier = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    area = F.sum(F.col("inner_area") + F.col("p").cast("double") * F.col("offset"))
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return (
        spans.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum("p").alias("positives"),
            F.sum("n").alias("negatives"),
            F.try_divide(area, pairs).alias("auc"),
        )
    )
