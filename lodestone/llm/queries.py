"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontaminate, jaccard, licenses, media, shards, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.reassemble(warc.as_records(_read(spark, sf_dir, "pages")))
    return done.select(F.substring("origin_id", 10, 20).cast("long").alias("page_id"), "segments", "length", "status", F.col("body").cast("string").alias("html"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.deduplicate(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_read(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.templates(_read(spark, sf_dir, "pages"), labels)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_warc, op4_toxicity, op5_license_scan, op6_media_columns, op7_sharding, op8_url_filters, op9_bpe, op10_ngram_jaccard_join)
}
ORACLE: dict[str, str] = {"op2_chat_formatting": chat.SQL, "op3_warc": warc.SQL, "op7_sharding": shards.SQL, "op10_ngram_jaccard_join": jaccard.SQL}
