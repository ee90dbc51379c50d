"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, str)):
        return str(v)
    return repr(round(float(v), 9) + 0.0) if hasattr(v, "__float__") else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry._core().oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry._core().queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    res = duck.execute(entry._core().oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in res.fetchall())
    floats = [c for c, t in df.dtypes if t == "double"]
    if floats:
        as_float = lambda rows: [tuple(repr(round(float(v), 9) + 0.0) if c in floats and v != "None" else v for c, v in zip(columns, r)) for r in rows]
        got, want = sorted(as_float(got)), sorted(as_float(want))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry._core().queries()) - set(entry._core().oracle_sql())))
def test_runs(spark, name):
    assert entry._core().queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
