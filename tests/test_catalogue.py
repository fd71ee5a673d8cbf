"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        p = f"{DATA}/{t}"
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    out = catalogue.queries()[name](spark, DATA)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(out.columns)
    order = sorted(names)
    want = sorted(repr([norm(x[names.index(c)]) for c in order]) for x in r.fetchall())
    assert sorted(repr([norm(x[c]) for c in order]) for x in rows) == want
