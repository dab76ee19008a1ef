"""The ten operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, mixing, near_duplicates, pii, quality, substrings, tokens, toxicity, urls
from .oracles import ORACLES
from .shared import table


def op1_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_decontamination(spark, sf_dir):
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates.judge(table(spark, sf_dir, "documents"), near_duplicates.NearParams(shingle=3, percent=85))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.judge(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark, sf_dir):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*cols)


def op10_chat(spark, sf_dir):
    from pyspark.sql import functions as F

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    typed = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(typed.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_url_filter, op4_decontamination, op5_near_duplicates, op6_token_counts, op7_substring_dedup, op8_toxicity, op9_quality_rules, op10_chat)}
