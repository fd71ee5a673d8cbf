"""Policies read from files.  Each customer has a file that says what its orders are: a module an order, and an exception from its first order to its last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import policyfile
from ..sources.document import values
from ..sources.scratch import cut
from .registry import Facts, query

DOMAIN = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'core' WHEN '2' THEN 'supporting' ELSE 'generic' END"


def files(f: Facts):
    """(doc, text): as a hand would write it; a customer with debts has a gate that no policy knows."""
    part = F.concat(F.lit("  m"), F.col("o_orderkey"), F.lit(":\n    paths: [src/"), F.col("o_orderkey"), F.lit("/**]   # an order\n    subdomain: "), F.expr(DOMAIN), F.lit("\n    layer: '"), F.col("o_orderstatus"), F.lit("'\n"))
    by = f.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("t"))))["t"], "").alias("modules"), F.min("o_orderkey").alias("a"), F.max_by(F.struct("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey").alias("b"))
    gate = F.when(F.col("c_acctbal") < 0, "sometimes").otherwise("required")
    head = F.concat(F.lit("version: 3\nowners: ['"), F.col("c_name"), F.lit("']\ngate: "), gate, F.lit('\nlayers: ["F", "O", "P"]\nmodules:\n'))
    tail = F.concat(F.lit("exceptions:\n- rule: graph\n  from: m"), F.col("a"), F.lit("\n  to: m"), F.col("b.o_orderkey"), F.lit("\n  expires: "), F.col("b.day"), F.lit("\n  why: >-\n    asked by\n    "), F.col("c_mktsegment"), F.lit("\n"))
    return f.customer.join(by, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("doc"), F.concat(head, F.coalesce("modules", F.lit("")), F.coalesce(tail, F.lit(""))).alias("text"))


def decoded(f: Facts):
    return cut(values(files(f)), "policy-values")


@query("policy_problems", """SELECT c_custkey::VARCHAR AS policy, 'gate' AS path, 'is not one of advisory, required' AS problem FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey::VARCHAR, 'modules', p FROM customer, (VALUES ('required')) x(p) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def policy_problems(f):
    return policyfile.problems(decoded(f))


@query("policy_rows", f"""WITH o AS (SELECT c.c_custkey::VARCHAR AS policy, 'm' || o_orderkey AS name, {DOMAIN} AS sub, o_orderstatus AS layer, o_orderkey AS k, c_name, c_mktsegment, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders JOIN customer c ON o_custkey = c_custkey WHERE c_acctbal >= 0),
x AS (SELECT policy, c_name, c_mktsegment, min(k) AS a, max(k) AS b, arg_max(day, k) AS day FROM o GROUP BY ALL)
SELECT policy, 'module' AS section, name, f.field, 0::INT AS pos, CASE f.field WHEN 'subdomain' THEN sub WHEN 'layer' THEN layer WHEN 'volatility' THEN CASE sub WHEN 'core' THEN 'high' ELSE 'low' END ELSE 'src/' || k || '/**' END AS value FROM o, (VALUES ('paths'), ('public'), ('subdomain'), ('layer'), ('volatility')) f(field)
UNION ALL SELECT policy, 'exception', 'graph m' || a || ' > m' || b, f.field, 0, CASE f.field WHEN 'rule' THEN 'graph' WHEN 'from' THEN 'm' || a WHEN 'to' THEN 'm' || b WHEN 'expires' THEN day ELSE 'asked by ' || c_mktsegment END FROM x, (VALUES ('rule'), ('from'), ('to'), ('expires'), ('why')) f(field)
UNION ALL SELECT policy, 'top', '', f.field, f.pos, CASE f.field WHEN 'owners' THEN c_name ELSE f.value END FROM x, (VALUES ('owners', 0, ''), ('gate', 0, 'required'), ('layers', 0, 'F'), ('layers', 1, 'O'), ('layers', 2, 'P')) f(field, pos, value)
UNION ALL SELECT policy, 'builtin', f.name, f.field, 0, f.value FROM x, (VALUES ('graph', 'mode', 'ask'), ('coupling', 'mode', 'deny'), ('duplication', 'mode', 'ask'), ('cycle', 'mode', 'deny'), ('layers', 'mode', 'deny'), ('unowned', 'mode', 'deny'), ('coupling', 'min_balance', '7')) f(name, field, value)""")
def policy_rows(f):
    v = decoded(f)
    return policyfile.rows(v, policyfile.problems(v))
