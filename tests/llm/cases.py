"""Awkward documents shared by the tests: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("simhash", T.StringType()), T.StructField("token_ids", T.StringType()), T.StructField("decoded", T.StringType()),
])
CLASH = ("a", "b", "c", "d", "e", "f")[:6]
LONG = " ".join(f"word{k % 977} und{k % 31}" for k in range(60_000))


def awkward(spark, texts=()):
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (None, "the same words again and again", "en"),
        (5, "the same words again and again", "en"), (6, "the  same words again and again", None),
        (7, "The same words again and agaiN", "de"), (7, "The same words again and agaiN", "de"),
        (8, LONG, "en"), (9, "12 34 !! ☃", None), (10, "été über naïve", "fr"),
        *[(100 + k, t, "en") for k, t in enumerate(texts)],
    ]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
