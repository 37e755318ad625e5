"""The corpus pipeline: language ID, near duplicates, repeated paragraphs, benchmark passages, then token ids.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontam, langid, ngram_join, paragraphs
from sparkloom.llm.common import collect_garbage, delete, shared_dir
from sparkloom.llm.queries import RANKS
from sparkloom.ship import ship

#: A document is rejected if it has no language, or its best language holds less than this share of its n-grams.
LEAST_SCORE = 0.2


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with n_chars brought up to date, in the order of ``columns``."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; rejects those without a letter or like no language."""
    filters = langid.learn(docs)
    kept = langid.predict(docs, filters, pred="_lang", score="_score")
    if filters.languages:
        return kept.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 on shingles of five words stays: the one with the smallest id. Rows are told apart by id and text."""
    groups = ngram_join.ngram_jaccard(docs, width=5, percent=80, with_hash=True)
    gone = groups.where("component_id is not null and (doc_id is null or doc_id <> component_id)")
    gone = gone.select(F.coalesce("doc_id", "_th").alias("_id"), "_th").distinct()
    named = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.col("_th")))
    return named.join(gone, ["_id", "_th"], "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs are cut out of all documents but the first that has them."""
    return _sized(paragraphs.substring_dedup(docs).select(*docs.columns), docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of the benchmark are cut out."""
    return _sized(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, which decode to their texts."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("token_ids"))


def _shipped(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        collect_garbage(spark)  # the stage before may have filled the executors' heaps
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _shipped(f)) for f in (language_id, near_duplicates, repeated_passages, benchmark_passages, token_ids)]

#: n-gram filters, paragraph banding and byte-pair merges are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one's is written; the one before the last stage's stays, as that stage is lazy."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
