"""Graph queries over the module graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query

R = "WITH RECURSIVE e AS (SELECT a, b FROM {:pairs} p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
C = R + ", c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component, count(*) + 1 AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"


@query("reachability", R + " SELECT a, b FROM r")
def reachability(f):
    return G.reach(f.pairs)


@query("scc_nodes", C + " SELECT node, component, size::BIGINT AS size FROM c")
def scc_nodes(f):
    return G.strong_components(f.pairs)


@query("rule_cycle", C + " SELECT 'cycle' AS rule, e.a AS \"from\", e.b AS \"to\" FROM e JOIN c x ON x.node = e.a JOIN c y ON y.node = e.b AND x.component = y.component")
def rule_cycle(f):
    return G.cycle_edges(f.pairs).select(F.lit("cycle").alias("rule"), F.col("a").alias("from"), F.col("b").alias("to"))


@query("cycle_metric", C + """, m AS (SELECT component, count(DISTINCT num % 2) = 1 AS one FROM c JOIN {:modules} m ON m.module = node GROUP BY component)
SELECT count(*)::BIGINT AS cycles, CASE WHEN count(*) = 0 THEN 'strong' WHEN bool_and(one) THEN 'poor' ELSE 'critical' END AS band FROM m""")
def cycle_metric(f):
    lang = f.modules.select(F.col("module").alias("node"), (F.col("num") % 2).alias("lang"))
    by = G.strong_components(f.pairs).join(lang, "node").groupBy("component").agg((F.count_distinct("lang") == 1).alias("one"))
    return by.agg(F.count("*").alias("cycles"), F.when(F.count("*") == 0, "strong").when(F.bool_and("one"), "poor").otherwise("critical").alias("band"))


@query("blast_radius", R + """ SELECT module AS node, coalesce(n, 0)::BIGINT AS blast, round(coalesce(n, 0) / greatest(1, (SELECT count(*) FROM {:modules} m) - 1), 6) AS relative
FROM {:modules} m LEFT JOIN (SELECT b, count(*) AS n FROM r WHERE a <> b GROUP BY b) x ON x.b = module""")
def blast_radius(f):
    return G.blast_radius(f.modules.select(F.col("module").alias("node")), f.pairs)


@query("longest_chain", C + """, d AS (SELECT DISTINCT coalesce(x.component, e.a) AS a, coalesce(y.component, e.b) AS b FROM e LEFT JOIN c x ON x.node = e.a LEFT JOIN c y ON y.node = e.b WHERE coalesce(x.component, e.a) <> coalesce(y.component, e.b)),
l(node, depth) AS (SELECT DISTINCT unnest([a, b]), 0 FROM d UNION SELECT d.b, l.depth + 1 FROM l JOIN d ON l.node = d.a)
SELECT node, max(depth)::INT AS depth FROM l GROUP BY node""")
def longest_chain(f):
    return G.longest_chain(f.pairs)


@query("volatility_cascade", """WITH RECURSIVE s AS (SELECT a, b FROM {:pairs} p JOIN {:modules} x ON x.module = a JOIN {:modules} y ON y.module = b WHERE (x.num + y.num) % 3 = 0),
h(node) AS (SELECT s.a FROM s JOIN {:modules} m ON m.module = s.b WHERE m.volatility = 'high' UNION SELECT s.a FROM h JOIN s ON s.b = h.node)
SELECT module AS node, volatility, CASE WHEN module IN (SELECT node FROM h) THEN 'high' ELSE volatility END AS effective FROM {:modules} m""")
def volatility_cascade(f):
    m = f.modules
    num = m.select("module", "num")
    s = f.pairs.join(num.withColumnsRenamed({"module": "a", "num": "x"}), "a").join(num.withColumnsRenamed({"module": "b", "num": "y"}), "b").where("(x + y) % 3 = 0")
    return G.cascade(m.select(F.col("module").alias("node"), "volatility"), s.select("a", "b"))


@query("containment", """WITH p AS (SELECT DISTINCT unnest([regexp_replace(target, '/[^/]*$', ''), CASE WHEN line % 2 = 0 THEN regexp_replace(target, '/[^/]*/[^/]*$', '') ELSE target END]) AS path FROM {:uses} u)
SELECT a.path, max_by(b.path, length(b.path)) AS parent, count(b.path)::BIGINT AS depth FROM p a LEFT JOIN p b ON starts_with(a.path, b.path || '/') GROUP BY a.path""")
def containment(f):
    u = f.uses
    p = u.select(F.explode(F.array(F.regexp_replace("target", "/[^/]*$", ""), F.when(F.col("line") % 2 == 0, F.regexp_replace("target", "/[^/]*/[^/]*$", "")).otherwise(F.col("target")))).alias("path")).distinct()
    return G.containment(p)


@query("alias_components", """WITH RECURSIVE k AS (SELECT c_custkey AS id, 'e' || CAST(c_custkey % 97 AS STRING) || c_mktsegment AS email, 'n' || CAST(c_nationkey AS STRING) || '-' || CAST(c_custkey % 41 AS STRING) AS name FROM customer),
p AS (SELECT id AS a, min(id) OVER (PARTITION BY email) AS b FROM k UNION SELECT id, min(id) OVER (PARTITION BY name) FROM k), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, x) AS (SELECT id, id FROM k UNION SELECT r.id, q.b FROM r JOIN q ON q.a = r.x) SELECT id, min(x) AS root FROM r GROUP BY id""")
def alias_components(f):
    k = f.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("e"), (F.col("c_custkey") % 97).cast("string"), "c_mktsegment").alias("email"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 41).cast("string")).alias("name"))

    def star(key):
        return k.join(k.groupBy(key).agg(F.min("id").alias("b")), key).select(F.col("id").alias("a"), "b")

    roots = G.components(star("email").unionAll(star("name")))
    return k.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


PARENTS = "SELECT o_orderkey AS a, CAST(o_orderkey // 2 AS BIGINT) AS b FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, CAST(o_orderkey // 3 AS BIGINT) FROM orders WHERE o_orderkey > 0 AND o_orderkey % 5 = 0"


@query("merge_base", f"""WITH RECURSIVE e AS ({PARENTS}), u(a, b) AS (SELECT DISTINCT a, a FROM e WHERE a >= (SELECT max(a) - 1 FROM e) UNION SELECT u.a, e.b FROM u JOIN e ON u.b = e.a),
c AS (SELECT b FROM u GROUP BY b HAVING count(DISTINCT a) = 2), v(b) AS (SELECT e.b FROM c JOIN e ON e.a = c.b UNION SELECT e.b FROM v JOIN e ON v.b = e.a)
SELECT b AS id FROM c WHERE b NOT IN (SELECT b FROM v)""")
def merge_base(f):
    o = f.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("a"))
    p = o.withColumn("b", F.expr("a div 2")).unionAll(o.where("a % 5 = 0").withColumn("b", F.expr("a div 3"))).distinct()
    top = o.agg(F.max("a").alias("id"))
    return G.merge_base(p, top, top.select((F.col("id") - 1).alias("id")))


@query("graph_nodes", "SELECT id, min_by(language, pos * 2 + CASE WHEN language = 'go' THEN 0 ELSE 1 END) AS language FROM (SELECT target AS id, CASE l.status WHEN 'F' THEN 'go' ELSE 'python' END AS language, line AS pos FROM {:uses} l) GROUP BY id")
def graph_nodes(f):
    return G.dedup_nodes(f.uses.select(F.col("target").alias("id"), F.when(F.col("status") == "F", "go").otherwise("python").alias("language"), F.col("line").alias("pos")))


@query("graph_edges", """SELECT "from", "to", kind, arg_min(language, priority * 1000000000 + pos) AS language, string_agg(DISTINCT site, ',' ORDER BY site) AS sites, string_agg(DISTINCT hint, ',' ORDER BY hint) AS hints FROM (
SELECT from_module AS "from", to_module AS "to", CASE WHEN qty % 2 = 0 THEN 'imports' ELSE 'depends_on' END AS kind, CASE part % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' ELSE 'python' END AS language, part % 3 AS priority, line AS pos, file AS site, hint FROM {:edges} e) GROUP BY ALL""")
def graph_edges(f):
    e = f.edges
    lang = F.col("part") % 3
    rows = e.select(F.col("from_module").alias("from"), F.col("to_module").alias("to"), F.when(F.col("qty") % 2 == 0, "imports").otherwise("depends_on").alias("kind"), F.when(lang == 0, "go").when(lang == 1, "typescript").otherwise("python").alias("language"), lang.alias("priority"), F.col("line").alias("pos"), F.col("file").alias("site"), "hint")
    return G.dedup_edges(rows)


@query("augment_modules", """SELECT module, owner, volatility, 'declared' AS origin FROM {:modules} m UNION ALL
SELECT DISTINCT to_module || '/' || split_part(target, '/', 3) AS module, m.owner, m.volatility, 'synthetic' AS origin FROM {:uses} u JOIN {:modules} m ON m.module = to_module""")
def augment_modules(f):
    m = f.modules.select("module", "owner", "volatility")
    inner = f.uses.select(F.col("to_module").alias("module"), F.split_part("target", F.lit("/"), F.lit(3)).alias("part")).distinct()
    made = inner.join(m, "module").select(F.concat_ws("/", "module", "part").alias("module"), "owner", "volatility", F.lit("synthetic").alias("origin"))
    return m.withColumn("origin", F.lit("declared")).unionByName(made)


@query("fan_in_out", """SELECT module, coalesce(i, 0)::BIGINT AS fan_in, coalesce(o, 0)::BIGINT AS fan_out FROM {:modules} m LEFT JOIN (SELECT b, count(DISTINCT a) AS i FROM {:pairs} p GROUP BY b) x ON x.b = module LEFT JOIN (SELECT a, count(DISTINCT b) AS o FROM {:pairs} p GROUP BY a) y ON y.a = module""")
def fan_in_out(f):
    i = f.pairs.groupBy(F.col("b").alias("module")).agg(F.count_distinct("a").alias("fan_in"))
    o = f.pairs.groupBy(F.col("a").alias("module")).agg(F.count_distinct("b").alias("fan_out"))
    return f.modules.select("module").join(i, "module", "left").join(o, "module", "left").fillna(0, ["fan_in", "fan_out"])
