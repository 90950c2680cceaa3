"""Registered query of the source audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import divergence


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
      counted AS MATERIALIZED (SELECT lang, source, term, sum(n) AS c, count(*) AS docs FROM (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(t) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
      kept AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS total FROM counted GROUP BY ALL HAVING sum(docs) >= 10),
      groups AS (SELECT DISTINCT lang, source FROM d),
      langs AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS n, count(*) AS v FROM kept GROUP BY lang),
      sizes AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM counted SEMI JOIN kept USING (lang, term) GROUP BY ALL),
      p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (CAST(coalesce(c, 0) AS HUGEINT) + 2)) // (coalesce(sizes.n, 0) + 2 * langs.v) AS p,
          1 + (1000000000 * (total + 2)) // (langs.n + 2 * langs.v) AS q
        FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counted USING (lang, source, term) LEFT JOIN sizes USING (lang, source)),
      pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
      priced AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      ranked AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN priced USING (lang, source, item)
        UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 10"""
}
