"""Every registered query with SQL against DuckDB on the same tables."""

import math
from collections import Counter

import pytest

from gristmill.plans import registry
from gristmill.plans.adapters import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, told = Counter(map(plain, df.select(*want.columns).collect())), Counter(map(plain, want.fetchall()))
    assert got == told, (list((got - told).items())[:2], list((told - got).items())[:2])
    assert told
