"""All registered queries of the passage engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import layouts, library, pages, reading, retrieval, structure

PARTS = (retrieval, library, pages, structure, reading, layouts)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.library_search(spark, sf_dir)
