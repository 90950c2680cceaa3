"""Registered queries of the classifiers: quality, languages, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, quality, url_filter


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where(language_id.fold(F.col("doc_id"), 5) != 0))
    held = F.coalesce(language_id.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return quality.score_quality(docs, model).select("doc_id", held, "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 3) != 1))
    held = F.coalesce(language_id.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return language_id.identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score", "rejected")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op5_quality_classifier": op5_quality_classifier, "op7_language_id": op7_language_id, "op10_url_filter": op10_url_filter}
SQL: dict[str, str] = {}
