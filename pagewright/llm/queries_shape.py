"""Registered queries of mixing, packing and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import fingerprints, mixing, packing


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.mix_taken(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_packing": op1_packing, "op2_mixing": op2_mixing, "op6_fingerprints": op6_fingerprints}
SQL: dict[str, str] = {}
