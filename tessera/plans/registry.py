"""Registry of the catalogue: name -> (query, oracle)."""

from __future__ import annotations

from ..sources.views import duck, view

QUERIES: dict = {}
ORACLES: dict = {}


class Facts:
    """The fact views of one data folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of Facts under name, with DuckDB SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return put
