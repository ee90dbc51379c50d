"""The queries that SQL can express, on the smallest tables."""

import os

import pytest

from siftwork.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in res.fetchall())
