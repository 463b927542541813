"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from filmcrate.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
