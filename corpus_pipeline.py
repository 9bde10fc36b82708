"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from murmuration.llm.queries import table, tokenizer_path
from murmuration.llm.rows import stored
from murmuration.sources.scratch import Scratch

ROW = "__row"
FEW_ROWS = 1 << 20  # eight bytes each


def without_rows(docs: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows whose numbers ``dropped`` has; few numbers, counted first, go to all tasks."""
    numbers = stored(dropped.select(ROW), scratch, "dropped")
    few = numbers.count() <= FEW_ROWS
    return docs.join(F.broadcast(numbers) if few else numbers.hint("merge"), ROW, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin."""
    dictionaries = language_id.learn_dictionaries(docs.where(language_id.training_rows(docs)))
    return language_id.identify_language(docs, dictionaries).where(~F.col("rejected")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest, then the one with the smallest id; one row of each."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns, "text_sha256")
    scratch = Scratch(spark)
    rows = stored(kept.withColumn(ROW, F.monotonically_increasing_id()), scratch, "numbered")
    first = rows.groupBy("text_sha256").agg(F.min(ROW).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    again = rows.select("text_sha256", ROW).join(first, "text_sha256").where(F.col(ROW) != F.col("__first"))
    return without_rows(rows, again, scratch).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-equal fingerprints, that with the smallest id; rows without an id come last."""
    # ``docs`` is a stored table: each scan numbers its rows alike.
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    groups = simhash.simhash_groups(rows.select(key.alias("doc_id"), "text"))
    dropped = groups.where(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(ROW))
    return without_rows(rows, dropped, Scratch(spark)).select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is verbatim benchmark text."""
    found = decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they give back."""
    coded = bpe.bpe_encode(docs, tokenizer_path())
    return coded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", decontaminate_documents),
    ("bpe", encode),
]

#: Compression sizes and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored in the shared folder before the next one."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(scratch.path(name))
        docs = spark.read.parquet(scratch.path(name))
    return docs
