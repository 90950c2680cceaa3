"""Every registered query with SQL gives DuckDB's rows; the others give rows of a stable schema."""

import math
import os

import pytest

from pagewright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) else repr(round(v, 8))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert len(df.columns) == len(set(df.columns))
        return
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(got) == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
