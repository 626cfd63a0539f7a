"""Every registered query gives the rows that its SQL gives in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from sheaf import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    place = [list(want.columns).index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


def test_queries_without_sql_give_rows(spark, sf):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
