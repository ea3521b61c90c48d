"""The operators as queries over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    embedding_dedup,
    packing,
    quality_rules,
    resampling,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filter,
)
from .common import table, texts_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(texts_table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(texts_table(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(texts_table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(texts_table(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts_table(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts_table(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(texts_table(spark, sf_dir))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sharding,
        op2_importance_resampling,
        op3_token_counts,
        op4_toxicity,
        op5_byte_bpe,
        op6_best_fit_packing,
        op7_simhash,
        op8_quality_rules,
        op9_embedding_dedup,
        op10_url_filter,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    """None of the ten has an SQL form: shard placement, packing and trained or sampled
    verdicts are not fixed by their contracts, and tokenising, XXH64 and closures over
    whole tables are beyond SQL. tests/llm holds each against brute force."""
    return {}
