"""The registered queries: each applies one operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, mixing, ngram_join, pii, quality, token_counts, topk, toxicity
from .common import fold, table

#: The vocabulary that op1 and op9 work with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return chat.digest(chat.format_chats(talks.unionByName(added)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4)
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder != 2)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"], cache=96 << 20)
    decoded = bpe.decode_documents(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_chat_formatting, op4_toxicity, op5_pii, op6_quality, op7_exact_topk, op8_ngram_join, op9_bpe, op10_nearest_neighbours)}
