"""The registered queries, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, exact_dedup, fim, media, mixing, near_dedup, packing, quality, secrets, toxicity, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), width=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.formatted(chat.paired(chat.conversations(table(spark, sf_dir, "conversations"))))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return out.select(F.col("chosen_id").alias("conv_id"), "rejected_id", "prefix_turns", digest("prompt"), digest("chosen"), digest("rejected"), "chosen_mask", "rejected_mask")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restored(fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digests(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_warc, op3_toxicity, op4_near_dedup, op5_mixing, op6_chat, op7_exact_dedup, op8_secrets, op9_media, op10_quality, op11_fim, op12_clustering, op13_packing)}
