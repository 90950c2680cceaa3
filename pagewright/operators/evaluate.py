"""Evaluation and operations: latencies, batch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency(timings: DataFrame) -> DataFrame:
    """mode, kind, p50, p95: the value at place floor(share x n), not interpolated."""
    w = Window.partitionBy("mode", "kind")
    t = timings.withColumn("i", F.row_number().over(w.orderBy("ms")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda f: F.max(F.when(F.col("i") == F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1), F.col("ms")))
    return t.groupBy("mode", "kind").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """batch, succeeded, failed, exit_code: 0 if all went well, 2 for some, else the code of the first failure."""
    bad = F.col("code") != 0
    r = results.groupBy("batch").agg(F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.min_by("code", F.when(bad, F.col("seq"))).alias("first"))
    code = F.when(F.col("failed") == 0, 0).when(F.col("succeeded") > 0, 2).otherwise(F.col("first"))
    return r.select("batch", "succeeded", "failed", code.alias("exit_code"))
