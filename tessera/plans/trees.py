"""Trees of two times: each order is a file of its customer's directory, with its lines as content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import trees
from .registry import Facts, query

#: What has happened since: orders without a clerk's change keep their content; the old tree lacks late orders, the new one those that were filled; one status was moved.
OLD, NEW = "o_orderdate < DATE '1998-01-01'", "o_orderstatus <> 'P'"
DIR = "'n' || c_nationkey || '/c' || o_custkey"


def files(f: Facts, side: str):
    o = f.orders.join(f.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    name = F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "o_custkey", F.when((F.lit(side == "new")) & (F.col("o_totalprice") > 300000), "/big").otherwise(""), F.lit("/o"), "o_orderkey")
    text = F.concat_ws("|", "o_orderkey", F.when((F.lit(side == "new")) & (F.col("o_orderpriority") == "5-LOW"), "urgent").otherwise(F.col("o_orderpriority")))
    return o.where(OLD if side == "old" else NEW).select(name.alias("file"), F.sha2(text, 256).alias("digest"))


@query("tree_changes", f"""WITH o AS (SELECT *, {DIR} AS dir FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT o_orderkey AS k, dir || '/o' || o_orderkey AS file, o_orderkey || '|' || o_orderpriority AS t FROM o WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01'),
a AS (SELECT o_orderkey AS k, dir || CASE WHEN o_totalprice > 300000 THEN '/big' ELSE '' END || '/o' || o_orderkey AS file, o_orderkey || '|' || CASE WHEN o_orderpriority = '5-LOW' THEN 'urgent' ELSE o_orderpriority END AS t FROM o WHERE {NEW}),
x AS (SELECT b.file AS bf, a.file AS af, b.t AS tb, a.t AS ta FROM b FULL JOIN a USING (k))
SELECT af AS file, 'renamed' AS change, bf AS old_file FROM x WHERE tb = ta AND bf <> af
UNION ALL SELECT af, CASE WHEN bf = af THEN 'changed' ELSE 'added' END, NULL FROM x WHERE af IS NOT NULL AND (bf IS NULL OR tb <> ta)
UNION ALL SELECT bf, 'removed', NULL FROM x WHERE bf IS NOT NULL AND (af IS NULL OR (tb <> ta AND bf <> af))""")
def tree_changes(f):
    return trees.compare(trees.tree(files(f, "old")), trees.tree(files(f, "new")))
