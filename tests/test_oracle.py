"""Every registered query against its SQL twin on the smallest tables, rows and values."""

import glob
import os

import duckdb
import pytest

from vitrail import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(str(plain(tuple(r))) for r in df.select(*columns).collect())
    theirs = duck.sql(ORACLE[name])
    assert sorted(theirs.columns) == columns
    rows = theirs.select(*[f'"{c}"' for c in columns]).fetchall()
    assert mine == sorted(str(plain(r)) for r in rows)
    assert mine


def test_every_query_with_sql_is_registered():
    assert set(ORACLE) <= set(QUERIES)
