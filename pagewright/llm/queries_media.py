"""Registered query of the media operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import chroma


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` is played as a recording; every hundredth is the source of a query recording."""
    return chroma.match_recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")


QUERIES = {"op4_chroma_fingerprints": op4_chroma_fingerprints}
SQL: dict[str, str] = {}
