"""Corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op11_exact", "op13_audit"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    got = Q.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(x[c] for c in columns) for x in got.collect()) == sorted(r.fetchall())
