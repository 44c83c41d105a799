"""Every query that has SQL against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from quern import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    show = lambda v: repr(v) if isinstance(v, float) else str(int(v)) if isinstance(v, decimal.Decimal) else str(v)
    got = sorted(tuple(map(show, r)) for r in df.select(*columns).collect())
    r = db.sql(queries.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    assert got == sorted(tuple(show(x[r.columns.index(c)]) for c in columns) for x in r.fetchall())
