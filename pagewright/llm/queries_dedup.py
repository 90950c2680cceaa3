"""Registered queries of near-duplicate joins and substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import ngram_join, substring_dedup, suffix_dedup


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.near_duplicates(docs)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup.dedup_spans(docs).select("doc_id", "n_removed", "words_removed", "text")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup, "op8_ngram_join": op8_ngram_join, "op9_substring_dedup": op9_substring_dedup}
SQL: dict[str, str] = {}
