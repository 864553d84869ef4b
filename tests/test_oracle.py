"""Every catalogued query against its independent DuckDB SQL on the smallest tables."""

import os

import pytest

from scripts.check_oracle import TABLES, digest
from tests.conftest import SF_SMALL

from trolley.plans.catalog import CATALOG

QUERIES = {name: e.build for name, e in CATALOG.items()}
SQL = {name: e.sql for name, e in CATALOG.items() if e.sql is not None}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(df.columns) > 0
        return
    res = duck.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
