"""Fact views over the driver's tables, in SQL that Spark and DuckDB both take.

They read whole tables.  Remainders deal out attributes (owners, hints, kinds)
that the tables lack; none of them limits rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CUTOFF = "1998-04-01"

VIEWS = {
    "modules": """SELECT n_name AS module, n_nationkey AS num, r_name AS layer, r_regionkey AS layer_pos, 'team' || CAST(n_nationkey % 6 AS STRING) AS owner,
      'unit' || CAST(n_nationkey % 8 AS STRING) AS deploy_unit, CASE n_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN NULL ELSE 'medium' END AS volatility,
      CASE n_nationkey % 6 WHEN 0 THEN 'Core' WHEN 1 THEN 'supporting' WHEN 3 THEN 'Generic' WHEN 4 THEN 'supporting' ELSE NULL END AS subdomain,
      CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE CAST('2001-08-01' AS DATE) - INTERVAL '17' DAY * n_nationkey END AS reviewed_at, CASE n_nationkey % 5 WHEN 0 THEN 'facade' WHEN 1 THEN 'shared_kernel' ELSE 'plain' END AS role
      FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "uses": """SELECT 'src/' || lower(n1.n_name) || '/f' || CAST(l_suppkey % 7 AS STRING) || '.go' AS file, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS line,
      'src/' || lower(n2.n_name) || '/' || CASE WHEN l_partkey % 3 = 0 THEN 'api' ELSE 'impl' END || '/g' || CAST(l_partkey % 5 AS STRING) || '.go' AS target,
      n1.n_name AS from_module, n2.n_name AS to_module, n1.n_nationkey AS from_num, n2.n_nationkey AS to_num, l_partkey % 3 = 0 AS public, CAST(o_orderdate AS DATE) AS day,
      l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS INT) AS qty, CAST(l_partkey AS BIGINT) AS part
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey""",
    "depends_on": "SELECT from_module AS module, to_module AS target FROM {:uses} u GROUP BY from_module, to_module HAVING count(*) % 3 <> 0",
    "base": f"SELECT * FROM {{:uses}} u WHERE day < DATE '{CUTOFF}'",
    "head": "SELECT * FROM {:uses} u WHERE qty <= 44",
    "added": f"SELECT DISTINCT file, line FROM {{:uses}} u WHERE day >= DATE '{CUTOFF}'",
    "pairs": "SELECT from_module AS a, to_module AS b FROM {:uses} u WHERE from_module <> to_module AND (from_num < to_num OR from_num = to_num + 1) GROUP BY from_module, to_module HAVING count(*) % 4 = 1",
    "edges": """SELECT from_module, to_module, file, line, from_num, to_num, CASE flag WHEN 'A' THEN 'contract' WHEN 'N' THEN CASE WHEN public THEN 'model' ELSE 'functional' END ELSE CASE WHEN qty > 40 THEN 'unknown' WHEN qty > 25 THEN 'intrusive' ELSE 'symmetric' END END AS hint,
      public, qty, part, status FROM {:uses} u""",
    "literals": "SELECT DISTINCT source AS module, 'd' || CAST(doc_id AS STRING) AS file, line AS value, doc_id, CASE doc_id % 10 WHEN 3 THEN 'test' WHEN 7 THEN 'generated' ELSE 'production' END AS class FROM (SELECT source, doc_id, {unnest} AS line FROM {documents}) t WHERE length(line) >= 12",
}
_SPARK = {"unnest": "explode(split(text, '\\n'))"}
_DUCK = {"unnest": "unnest(string_split(text, chr(10)))"}


def _bind(name: str, tables, extra: dict) -> str:
    def put(m: re.Match) -> str:
        key = m[1]
        if key.startswith(":"):
            return f"({_bind(key[1:], tables, extra)})"
        return extra[key] if key in extra else tables(key)

    return re.sub(r"\{(:?\w+)\}", put, VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_bind(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", _SPARK).replace("\\n", "\\\\n"))


def duck(sql: str) -> str:
    """A query for DuckDB, with {:view} replaced by the views' SQL."""
    return re.sub(r"\{:(\w+)\}", lambda m: f"({_bind(m[1], lambda t: t, _DUCK)})", sql)
