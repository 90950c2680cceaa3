"""The training-data pipeline: each stage works on all that the stage before kept.

Every stage gives an empty table for an empty one, takes nulls in any column, and keeps columns that it doesn't know, but for
the last. Repeated rows: language ID and mixing treat them as documents of their own, the n-gram join keeps one of them, the
substring stage takes rows of equal id and text as one document, packing gives each a slot. Ties: see the operators.

`run` applies the stages in memory; a runner may as well write each result as Parquet and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, mixing, ngram_join, packing, substring_dedup
from pagewright.llm.common import materialize, word_count


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects (no letter, or unlike every learned language) go."""
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 3) != 1))
    return language_id.identify_languages(docs, model).where(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the least doc_id stays."""
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated runs of sentences go; a document of which no word is left goes."""
    cut = substring_dedup.dedup_spans(docs).where((F.col("n_removed") == 0) | (word_count(F.col("text")) > 0))
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: whole documents are drawn until each source has its target share; some are drawn up to three times."""
    return mixing.mix_documents(docs).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: length bucket, batch and slot of each drawn document."""
    return packing.pack(docs).select("doc_id", "source", "n_tokens", "bucket", "bucket_length", "batch", "slot", "padding")


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"after-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: classification, joins by sampled paths and dynamic programming aren't expressible; see tests/llm.
ORACLE_SQL = None
