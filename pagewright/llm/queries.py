"""All registered queries of this subpackage and their DuckDB SQL."""

from pagewright.llm import queries_audit, queries_classify, queries_dedup, queries_media, queries_shape, queries_vectors

PARTS = (queries_classify, queries_shape, queries_dedup, queries_media, queries_audit, queries_vectors)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
