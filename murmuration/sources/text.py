"""Delimited text readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, columns: list[str], with_position: bool = True,
                   surplus: str = "error") -> DataFrame:
    """Comma-separated files with one header line; every comma parts cells, every cell arrives as trimmed text.

    ``row_id`` follows the order of the files by name and of the lines in them (increasing, not consecutive).  Cells
    missing at the end of a short line are null, so the non-empty filter sees the full column count.  A line with
    more cells stops the job, or with ``surplus='ignore'`` keeps the leading ones.
    """
    if surplus not in ("error", "ignore"):
        raise ValueError("surplus must be 'error' or 'ignore'")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_surplus"]])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", "")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if surplus == "error":
        stop = F.raise_error(F.concat(F.lit("a line has more cells than columns: "), F.col("_surplus")))
        df = df.withColumn(columns[0], F.when(F.col("_surplus").isNull(), F.col(columns[0])).otherwise(stop))
    if not with_position:
        return df.select(*columns)
    # Spark orders the pieces of files by size; within a piece rows keep their order.
    piece = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = df.select(*columns, piece.alias("_piece"), F.monotonically_increasing_id().alias("_at"))
    order = F.row_number().over(Window.orderBy("_piece")) - 1  # one row for each piece of a file
    pieces = placed.select("_piece").distinct().withColumn("_rank", order)
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    row_id = F.shiftleft(F.col("_rank").cast("long"), 33).bitwiseOR(within)
    return placed.join(pieces, "_piece").select(*columns, row_id.alias("row_id"))


def read_cells(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every line, header included, as an array of trimmed cells; lines may differ in length.

    ``keys`` are the names of folders (``name=value``) to keep as columns.
    """
    return spark.read.text(path).select(
        *keys, F.transform(F.split("value", ","), lambda cell: F.trim(cell)).alias("cells")
    )


def read_curve(spark: SparkSession, path: str, algo: str, keys: Sequence[str] = ()) -> DataFrame:
    """Headerless files with one best fitness per line, numbered from zero in file order; ``keys`` as in ``read_cells``.

    A curve has one line per generation, a number set by the trainer and not by the data.
    """
    lines = spark.read.schema("best_fitness double").csv(path).withColumn("line", F.monotonically_increasing_id())
    position = F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy("line")) - 1
    return lines.select(F.lit(algo).alias("algo"), *keys, position.alias("iter"), "best_fitness")
