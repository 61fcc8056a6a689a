"""Curation of a corpus in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone import state
from lodestone.llm import bpe, decontaminate, jaccard, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it is fitted on the labelled documents of this stage's input."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, weights)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one of the least doc_id."""
    return jaccard.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_unleaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", clean), ("ngram_jaccard_join", unlike), ("decontamination", unleaked), ("bpe", tokens)]

#: None of the stages is an SQL query: the tests hold their rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the whole documents table. A stage's table goes when the next one's is written, the last with the session."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = state.write(stage(spark, docs, sf_dir))
        if before:
            state.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
