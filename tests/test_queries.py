"""Every named query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from auralake import plans

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {file.split('.')[0]} AS FROM '{FOLDER}/{file}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, base, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        return
    want = base.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall()), key=repr)
