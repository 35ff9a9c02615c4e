"""Registered queries of the operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import (
    bagminhash,
    chat,
    divergence,
    linededup,
    mixing,
    packing,
    pii,
    pitmanyor,
    prefixbpe,
    quality,
    runindex,
    topk,
    whitening,
)
from wardflow.llm.common import read
from wardflow.llm.oracles import CHECKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["CHECKS", "QUERIES"]


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read(spark, folder, "documents"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.deduplicated(read(spark, folder, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select(
        "doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), kept.alias("kept_sha256")
    )


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, folder, "documents")))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.verdicts(read(spark, folder, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


@query
def op5_bagminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, folder, "documents"))


@query
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


@query
def op7_run_index_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = runindex.deduplicated(read(spark, folder, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


@query
def op8_pivot_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(read(spark, folder, "embeddings"))


@query
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


@query
def op10_pitman_yor_score(spark: SparkSession, folder: str) -> DataFrame:
    return pitmanyor.score(read(spark, folder, "documents"))


@query
def op11_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = prefixbpe.decode(prefixbpe.encode(read(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op12_cholesky_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))
