"""Metrics, dimensions and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from .coupling import MONO, W, classified
from .registry import query


@query("encapsulation", f"""{W}, k AS (SELECT count(*) FILTER (strength = 'contract') AS a, count(*) FILTER (strength = 'intrusive') AS b, count(*) AS n FROM c WHERE boundary)
SELECT a::BIGINT AS contract, b::BIGINT AS intrusive, CASE WHEN b = 0 THEN NULL ELSE round(a / (a + b), 6) END AS value, CASE WHEN b = 0 THEN 'n/a' WHEN (a + b) / n >= 0.8 THEN 'high' WHEN (a + b) / n >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM k""")
def encapsulation(f):
    e = classified(f).where(C.boundary(F.col("distance")))
    k = e.agg(F.count_if(F.col("strength") == "contract").alias("contract"), F.count_if(F.col("strength") == "intrusive").alias("intrusive"), F.count("*").alias("n"))
    ab = F.col("contract") + F.col("intrusive")
    share = F.when(ab > 0, ab / F.when(F.col("n") > 0, F.col("n")))
    return k.select("contract", "intrusive", F.when(F.col("intrusive") > 0, F.round(F.col("contract") / F.when(ab > 0, ab), 6)).alias("value"), F.when(F.col("intrusive") == 0, "n/a").when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low").alias("confidence"))


@query("unbalanced_edge", f"""{W}, k AS (SELECT count(*) FILTER (strength = 'intrusive' AND vol = 'high') AS n, count(*) FILTER (vol NOT IN ('undeclared', 'unknown')) AS known FROM c WHERE boundary)
SELECT CASE WHEN known > 0 THEN n END::BIGINT AS value, CASE WHEN known = 0 THEN 'n/a' WHEN n = 0 THEN 'strong' ELSE 'poor' END AS band FROM k""")
def unbalanced_edge(f):
    k = classified(f).where(C.boundary(F.col("distance"))).agg(F.count_if((F.col("strength") == "intrusive") & (F.col("vol") == "high")).alias("n"), F.count_if(~F.col("vol").isin("undeclared", "unknown")).alias("known"))
    return k.select(F.when(F.col("known") > 0, F.col("n")).alias("value"), F.when(F.col("known") == 0, "n/a").when(F.col("n") == 0, "strong").otherwise("poor").alias("band"))


TOOLS = "SELECT p_brand AS tool, count(*) AS applicable, count(*) FILTER (p_size <= 45) AS seen, count(*) FILTER (p_size BETWEEN 40 AND 41) AS unresolved FROM part GROUP BY p_brand"


def tools(f):
    return f.part.groupBy(F.col("p_brand").alias("tool")).agg(F.count("*").alias("applicable"), F.count_if(F.col("p_size") <= 45).alias("seen"), F.count_if(F.col("p_size").between(40, 41)).alias("unresolved"))


@query("coverage_metric", f"SELECT sum(seen)::BIGINT AS extracted, sum(applicable)::BIGINT AS applicable, round(sum(seen) / sum(applicable), 6) AS value, CASE WHEN sum(unresolved) / sum(seen) <= 0.05 THEN 'high' WHEN sum(unresolved) / sum(seen) <= 0.2 THEN 'medium' ELSE 'low' END AS confidence, count(*) FILTER (seen = applicable)::BIGINT AS complete FROM ({TOOLS})")
def coverage_metric(f):
    miss = F.sum("unresolved") / F.sum("seen")
    return tools(f).agg(F.sum("seen").alias("extracted"), F.sum("applicable").alias("applicable"), F.round(F.sum("seen") / F.sum("applicable"), 6).alias("value"), F.when(miss <= 0.05, "high").when(miss <= 0.2, "medium").otherwise("low").alias("confidence"), F.count_if(F.col("seen") == F.col("applicable")).alias("complete"))


@query("coverage_gaps", f"SELECT tool, (applicable - seen)::BIGINT AS missing, unresolved::BIGINT AS unresolved FROM ({TOOLS}) WHERE seen < applicable OR unresolved > 0")
def coverage_gaps(f):
    return tools(f).where("seen < applicable OR unresolved > 0").select("tool", (F.col("applicable") - F.col("seen")).alias("missing"), "unresolved")


SCORE = "least(round(100 * (avg(balance) - 1) / 9), CASE WHEN count(*) FILTER (mono) > 0 AND count(*) FILTER (mono) >= 0.05 * count(*) THEN 40 WHEN count(*) FILTER (severity = 'critical') > 0 THEN 60 ELSE 100 END)"


@query("coupling_balance", f"""{W}, k AS (SELECT *, {MONO} AS mono FROM c WHERE boundary), s AS (SELECT round(avg(balance), 6) AS mean, {SCORE}::INT AS score, count(balance)::BIGINT AS edges, count(*) - count(balance) AS abstained FROM k)
SELECT mean, score, edges, CASE WHEN edges = 0 THEN 'n/a' WHEN score <= 20 THEN 'critical' WHEN score <= 40 THEN 'poor' WHEN score <= 60 THEN 'mixed' WHEN score <= 80 THEN 'serviceable' ELSE 'strong' END AS band FROM s""")
def coupling_balance(f):
    k = classified(f).where(C.boundary(F.col("distance"))).withColumn("mono", C.monolith())  # abstained edges count for the share
    cap = F.when((F.count_if("mono") > 0) & (F.count_if("mono") >= 0.05 * F.count("*")), 40).when(F.count_if(F.col("severity") == "critical") > 0, 60).otherwise(100)
    s = k.agg(F.round(F.avg("balance"), 6).alias("mean"), F.least(F.round(100 * (F.avg("balance") - 1) / 9), cap).cast("int").alias("score"), F.count("balance").alias("edges"))
    x = F.col("score")
    return s.withColumn("band", F.when(F.col("edges") == 0, "n/a").when(x <= 20, "critical").when(x <= 40, "poor").when(x <= 60, "mixed").when(x <= 80, "serviceable").otherwise("strong"))


@query("effort_score", f"{W} SELECT from_module AS module, round(sum(balance * qty) / sum(qty), 6) AS weighted, sum(qty)::BIGINT AS weight FROM c WHERE balance IS NOT NULL GROUP BY from_module HAVING sum(qty) > 0")
def effort_score(f):
    return classified(f).where("balance IS NOT NULL").groupBy(F.col("from_module").alias("module")).agg(F.round(F.sum(F.col("balance") * F.col("qty")) / F.sum("qty"), 6).alias("weighted"), F.sum("qty").cast("long").alias("weight")).where("weight > 0")


SEEN = """(SELECT 'modules' AS fact, count(*) AS n FROM {:modules} m UNION ALL SELECT 'edges', count(*) FROM {:edges} e UNION ALL SELECT 'owners', count(DISTINCT owner) FROM {:modules} m UNION ALL SELECT 'coverage', count(*) FROM part)"""


@query("dimensions", f"""{W} SELECT 'structure' AS dimension, 'modules' AS name, count(*)::DOUBLE AS value FROM {{:modules}} m UNION ALL SELECT 'coupling', 'mean_balance', round(avg(balance), 6) FROM c WHERE boundary UNION ALL SELECT 'coupling', 'scored', count(balance)::DOUBLE FROM c WHERE boundary
UNION ALL SELECT 'testability', 'files', count(*)::DOUBLE FROM part UNION ALL SELECT 'operations', 'deploy_units', count(DISTINCT deploy_unit)::DOUBLE FROM {{:modules}} m UNION ALL SELECT 'modularity', 'layers', count(DISTINCT layer)::DOUBLE FROM {{:modules}} m UNION ALL SELECT 'change_locality', 'collected', NULL""")
def dimensions(f):
    e = classified(f).where(C.boundary(F.col("distance")))

    def row(d, n, df, v):
        return df.agg(v.cast("double").alias("value")).select(F.lit(d).alias("dimension"), F.lit(n).alias("name"), "value")

    m = f.modules
    out = row("structure", "modules", m, F.count("*"))
    for x in (row("coupling", "mean_balance", e, F.round(F.avg("balance"), 6)), row("coupling", "scored", e, F.count("balance")), row("testability", "files", f.part, F.count("*")), row("operations", "deploy_units", m, F.count_distinct("deploy_unit")), row("modularity", "layers", m, F.count_distinct("layer")), row("change_locality", "collected", m.limit(0), F.max(F.lit(0.0)))):
        out = out.unionByName(x)
    return out


@query("distance_context", "SELECT count(DISTINCT owner)::BIGINT AS owners, count(DISTINCT deploy_unit)::BIGINT AS units, CASE WHEN count(DISTINCT owner) = 0 THEN 'none' WHEN count(DISTINCT owner) = 1 THEN 'single owner' ELSE 'many owners' END AS owner_model FROM {:modules} m")
def distance_context(f):
    n = F.count_distinct("owner")
    return f.modules.agg(n.alias("owners"), F.count_distinct("deploy_unit").alias("units"), F.when(n == 0, "none").when(n == 1, "single owner").otherwise("many owners").alias("owner_model"))


@query("topology_reconcile", "SELECT count(*) FILTER (a.module IS NOT NULL AND b.module IS NOT NULL AND a.unit = b.unit)::BIGINT AS agreed, count(*) FILTER (a.module IS NOT NULL AND b.module IS NOT NULL AND a.unit <> b.unit)::BIGINT AS conflicting, count(*) FILTER (b.module IS NULL)::BIGINT AS declared_only, count(*) FILTER (a.module IS NULL)::BIGINT AS found_only FROM (SELECT module, deploy_unit AS unit FROM {:modules} m WHERE num % 4 <> 3) a FULL JOIN (SELECT module, 'unit' || CAST(num % 7 AS STRING) AS unit FROM {:modules} m WHERE num % 5 <> 4) b ON a.module = b.module")
def topology_reconcile(f):
    a = f.modules.where("num % 4 <> 3").select("module", F.col("deploy_unit").alias("declared"))
    b = f.modules.where("num % 5 <> 4").select("module", F.concat(F.lit("unit"), (F.col("num") % 7).cast("string")).alias("found"))
    d, x = F.col("declared"), F.col("found")
    return a.join(b, "module", "full").agg(F.count_if(d == x).alias("agreed"), F.count_if(d != x).alias("conflicting"), F.count_if(x.isNull()).alias("declared_only"), F.count_if(d.isNull()).alias("found_only"))


@query("owner_provenance", "SELECT CASE WHEN num % 7 = 0 THEN 'fallback' WHEN num % 3 = 0 THEN 'codeowners' ELSE 'git' END AS provenance, count(*)::BIGINT AS modules, count(DISTINCT owner)::BIGINT AS owners FROM {:modules} m GROUP BY 1")
def owner_provenance(f):
    p = F.when(F.col("num") % 7 == 0, "fallback").when(F.col("num") % 3 == 0, "codeowners").otherwise("git")
    return f.modules.groupBy(p.alias("provenance")).agg(F.count("*").alias("modules"), F.count_distinct("owner").alias("owners"))


@query("function_length", "SELECT p_type AS module, quantile_disc(p_size, 0.5)::INT AS p50, quantile_disc(p_size, 0.9)::INT AS p90, max(p_size)::INT AS longest, count(*) FILTER (p_size > 40)::BIGINT AS over, count(*)::BIGINT AS observed FROM part GROUP BY p_type")
def function_length(f):
    q = lambda p: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY p_size) AS INT)")
    return f.part.groupBy(F.col("p_type").alias("module")).agg(q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("p_size").alias("longest"), F.count_if(F.col("p_size") > 40).alias("over"), F.count("*").alias("observed"))


@query("seam_census", f"{W} SELECT a.layer AS repo, CASE WHEN grouping(distance) = 0 THEN distance END AS distance, count(*)::BIGINT AS edges, count(DISTINCT from_module || '>' || to_module)::BIGINT AS seams FROM c JOIN {{:modules}} a ON a.module = from_module GROUP BY GROUPING SETS ((a.layer, distance), (a.layer))")
def seam_census(f):
    e = classified(f).withColumn("repo", F.col("from_layer")).withColumn("seam", F.concat_ws(">", "from_module", "to_module"))
    return e.groupingSets([[F.col("repo"), F.col("distance")], [F.col("repo")]], F.col("repo"), F.col("distance")).agg(F.count("*").alias("edges"), F.count_distinct("seam").alias("seams")).select("repo", "distance", "edges", "seams")


@query("coverage_rollup", """WITH f AS (SELECT l_partkey AS part, max(l_linenumber) AS covered, count(DISTINCT l_returnflag) AS formats, min(CASE WHEN l_linestatus = 'F' THEN 7 ELSE 9 END) AS total, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN 7 ELSE 9 END) AS totals FROM lineitem GROUP BY l_partkey)
SELECT p_brand AS module, count(*)::BIGINT AS files, count(*) FILTER (totals > 1)::BIGINT AS incompatible, sum(CASE WHEN totals = 1 THEN covered END)::BIGINT AS covered, sum(CASE WHEN totals = 1 THEN total END)::BIGINT AS total, round(sum(CASE WHEN totals = 1 THEN covered END) / sum(CASE WHEN totals = 1 THEN total END), 6) AS ratio FROM f JOIN part ON part = p_partkey GROUP BY p_brand""")
def coverage_rollup(f):
    total = F.when(F.col("l_linestatus") == "F", 7).otherwise(9)
    by = f.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("covered"), F.min(total).alias("total"), (F.min(total) != F.max(total)).alias("bad"))
    ok = lambda c: F.when(~F.col("bad"), F.col(c))
    return by.join(f.part.select("p_partkey", F.col("p_brand").alias("module")), "p_partkey").groupBy("module").agg(F.count("*").alias("files"), F.count_if("bad").alias("incompatible"), F.sum(ok("covered")).cast("long").alias("covered"), F.sum(ok("total")).cast("long").alias("total"), F.round(F.sum(ok("covered")) / F.sum(ok("total")), 6).alias("ratio"))
