"""Registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    chat_format,
    decontaminate,
    embedding_dedup,
    fill_middle,
    filter_audit,
    language_id,
    line_dedup,
    ngram_join,
    secret_scan,
    token_counts,
    topk_search,
    toxicity,
)
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(spark, table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(spark, table(spark, sf_dir, "conversations"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.digest(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_secret_scan,
        op3_toxicity,
        op4_line_dedup,
        op5_ngram_join,
        op6_bpe,
        op7_decontamination,
        op8_token_counts,
        op9_chat_format,
        op10_embedding_dedup,
        op11_filter_audit,
        op12_topk_search,
        op13_fill_middle,
    )
}

ORACLES = {
    "op4_line_dedup": line_dedup.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_topk_search": topk_search.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
