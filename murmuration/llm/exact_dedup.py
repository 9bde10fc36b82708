"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.rows import without

WHITE_SPACE = " \t\n\x0b\x0c\r"
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]
_SPAN = Decimal(2**65)
_TOP = Decimal(2**64 + 2**63 - 1)


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for character in WHITE_SPACE:
        out = F.replace(out, F.lit(character), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def _precedence(text: Column, doc_id: Column) -> Column:
    """One number that is largest for the longest text, then the smallest id; rows without an id come last.

    A decimal fits the fixed slots of a hash aggregate, so that copies are combined before the shuffle without
    a sort; a struct would not.
    """
    by_id = F.when(doc_id.isNull(), F.lit(Decimal(0))).otherwise(F.lit(_TOP) - doc_id.cast("decimal(20,0)"))
    length = F.char_length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)")
    return (length * F.lit(_SPAN) + by_id).cast("decimal(38,0)")


def _id_of(precedence: Column) -> Column:
    by_id = precedence % F.lit(_SPAN)
    return F.when(by_id != 0, (F.lit(_TOP) - by_id).cast("long"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashed=content_hash) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after removal of ASCII white space.  Rows are grouped by a 128-bit hash *and*
    the bytes behind it, so texts that share a hash are told apart; copies are combined before the shuffle,
    however many there are.  A row finds its class by that hash together with the SHA-256 of the text, which is a
    join that Spark splits where a key is hot.

    Null texts count as empty, empty texts form a group.  Of equal texts the longest original stays, then the
    smallest id; a null id loses against every other id.  Rows that repeat the kept id with a text of the same
    length cannot be told apart and are all kept.  Ids are integers.  Columns of the input named like a result are
    replaced, all others stay.  ``hashed`` is there for tests of collisions.
    """
    base = without(docs, OUTPUT)
    marked = base.withColumns({"__text": squeezed(F.col(text)), "__rank": _precedence(F.col(text), F.col(doc_id))})
    marked = marked.withColumns({"__hash": hashed(F.col("__text")), "text_sha256": F.sha2(F.col("__text"), 256)})
    classes = (
        marked.groupBy("__hash", "__text")
        .agg(F.count("*").alias("group_size"), F.max("__rank").alias("__best"))
        .select("__hash", F.sha2(F.col("__text"), 256).alias("text_sha256"), "group_size", "__best")
    )
    return marked.drop("__text").join(classes, ["__hash", "text_sha256"]).select(
        *base.columns,
        _id_of(F.col("__best")).alias("keep_id"),
        "group_size",
        (F.col("__rank") == F.col("__best")).alias("kept"),
        "text_sha256",
    )
