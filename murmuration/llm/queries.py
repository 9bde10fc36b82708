"""The registered queries of this subpackage; each runs its operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    html_text,
    kneser_ney,
    language_id,
    line_dedup,
    phrases,
    simhash,
    spelling,
    suffix_dedup,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    training = language_id.training_rows(docs)
    dictionaries = language_id.learn_dictionaries(docs.where(training))
    found = language_id.identify_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (~language_id.training_rows(found)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string")))
    return found.withColumn("__items", F.sort_array(items)).select(
        "doc_id", "n_words", "n_hit", F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = toxicity.sampled(table(spark, sf_dir, "labels"))
    labels = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs.join(F.broadcast(labels), "doc_id"), ["low_quality", "toxic"])
    found = toxicity.score_toxicity(docs, chain)
    return found.select("doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), "p_low_quality")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.quality(docs, trusted)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    read = chat.format_chats(turns).select(
        "conv_id", chat.read_chats(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("segments")).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said_in_turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_in_turns, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(docs, min_count=30, top=2000, covered=80)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def registered() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_html_extraction": op5_html_extraction,
        "op6_toxicity": op6_toxicity,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_line_dedup": op11_line_dedup,
        "op12_phrases": op12_phrases,
        "op13_spelling_variants": op13_spelling_variants,
    }
