"""Registered queries over vectors: nearest neighbours, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import centroids, posting_lists


def op12_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return posting_lists.nearest_rows(vectors, "vec_id", "embedding")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.cluster_vectors(vectors)


def _lloyd_sql(clusters: int = 8, rounds: int = 10) -> str:
    """All rounds written out, a vector's components as rows."""
    text = f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      x AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS d FROM kept),
      c0 AS MATERIALIZED (SELECT k, unnest(v) AS m, unnest(range(64)) AS d
        FROM (SELECT v, CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INT) AS k FROM kept) WHERE k < {clusters})"""
    for i in range(rounds + 1):
        text += f""",
      a{i} AS MATERIALIZED (SELECT vec_id, min({{'far': far, 'k': k}}) AS near FROM (SELECT vec_id, k, CAST(sum((x - m) * (x - m)) AS BIGINT) AS far FROM x JOIN c{i} USING (d) GROUP BY ALL) GROUP BY vec_id)"""
        if i < rounds:
            text += f""",
      s{i} AS (SELECT near.k AS k, d, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id) GROUP BY ALL),
      c{i + 1} AS MATERIALIZED (SELECT k, CAST(CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS m, d FROM c{i} LEFT JOIN s{i} USING (k, d))"""
    return text + f"""
      SELECT vec_id, near.k AS cluster, near.far AS distance, CAST(sum(near.far) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
        CAST(sum(near.far) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
      FROM a{rounds} JOIN (SELECT k, sha256(string_agg(m, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY k) ON k = near.k"""


QUERIES = {"op12_posting_lists": op12_posting_lists, "op13_centroid_clustering": op13_centroid_clustering}
SQL = {"op13_centroid_clustering": _lloyd_sql()}
