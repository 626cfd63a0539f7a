import duckdb
import pytest

from sheaf.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())
