"""Completeness, warnings, scope and edges of a node."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope, state
from ..operators.uses import paths_table
from . import coupling
from .registry import query

NEED = "(VALUES " + ", ".join(f"('{d}', {k}, '{f}', {str(f in claim).lower()})" for d, (claim, rest) in state.FACTS.items() for k, f in enumerate(claim + rest)) + ") n(dimension, pos, fact, claim)"


@query("promotion", f"""WITH s AS (SELECT c_custkey AS subject, n.*, CASE WHEN (c_custkey + length(fact)) % 4 < 2 THEN true WHEN c_custkey % 3 = 0 THEN false END AS applies FROM customer, {NEED})
SELECT subject, dimension, CASE WHEN count(*) FILTER (claim AND applies IS NULL) = 0 THEN 'measured' WHEN count(*) FILTER (claim AND applies) > 0 THEN 'partial' ELSE 'unmeasured' END AS status, coalesce(string_agg(fact, '; ' ORDER BY pos) FILTER (claim AND applies IS NULL), '') AS missing FROM s GROUP BY subject, dimension""")
def promotion(f):
    all_ = f.spark.createDataFrame([(d, x) for d, (claim, rest) in state.FACTS.items() for x in claim + rest], "dimension string, fact string")
    rows = f.customer.select(F.col("c_custkey").alias("subject")).join(F.broadcast(all_), how="cross")
    applies = F.when((F.col("subject") + F.length("fact")) % 4 < 2, True).when(F.col("subject") % 3 == 0, False)
    return state.promoted(rows, rows.withColumn("applies", applies).where("applies IS NOT NULL"))


@query("bands", "SELECT p_partkey, CASE WHEN s >= 9 THEN 'strong' WHEN s >= 7 THEN 'serviceable' WHEN s >= 5 THEN 'mixed' WHEN s >= 3 THEN 'poor' ELSE 'critical' END AS band, CASE WHEN s < 3 THEN 'critical' WHEN s < 5 THEN 'poor' WHEN s < 7 OR c = 'low' THEN 'mixed' WHEN s < 9 OR c = 'medium' THEN 'serviceable' ELSE 'strong' END AS capped FROM (SELECT p_partkey, p_size / 5 AS s, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS c FROM part)")
def bands(f):
    k = F.col("p_partkey") % 3
    confidence = F.when(k == 0, "high").when(k == 1, "medium").otherwise("low")
    of = state.band(F.col("p_size") / 5)
    return f.part.select("p_partkey", of.alias("band"), state.capped(of, confidence).alias("capped"))


@query("health_warnings", """WITH x AS (SELECT l_suppkey AS subject, count(*) FILTER (l_quantity > 49) AS gaps, count(*) AS total, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE count(*) END AS scored, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE count(*) FILTER (l_returnflag <> 'A') END AS ext, count(*) FILTER (l_returnflag = 'A') AS same FROM lineitem GROUP BY l_suppkey)
SELECT subject, 'coverage gap' AS warning FROM x WHERE gaps > 0 UNION ALL SELECT subject, 'no edge scored' FROM x WHERE scored = 0 UNION ALL SELECT subject, 'strength unknown everywhere' FROM x WHERE scored = 0 AND ext = 0 AND total > 0
UNION ALL SELECT subject, 'no internal edges' FROM x WHERE scored = 0 AND ext > 0 AND total = same + ext AND subject % 3 <> 0 UNION ALL SELECT subject, 'no file in a declared module' FROM x WHERE subject % 5 = 0""")
def health_warnings(f):
    one = F.col("l_suppkey")
    x = f.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 49).alias("gaps"), F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "A").alias("ext"), F.count_if(F.col("l_returnflag") == "A").alias("same_module"))
    x = x.select(one.alias("subject"), "gaps", "total", F.when(one % 2 == 0, 0).otherwise(F.col("total")).alias("scored"), F.col("total").alias("abstained"), F.when(one % 4 == 0, 0).otherwise(F.col("ext")).alias("external"), "same_module", (one % 3 != 0).alias("python_ok"), (one % 5).alias("files_owned"), F.lit(True).alias("declared"))
    return state.health(x)


LADDER = "(VALUES " + ", ".join(f"('{d}', {r}::INT)" for d, r in state.LADDER) + ") l(distance, rung)"


@query("distance_ladder", f"{coupling.W} SELECT l.distance, rung, coalesce(n, 0)::BIGINT AS edges FROM {LADDER} LEFT JOIN (SELECT distance, count(*) AS n FROM c GROUP BY distance) x ON x.distance = l.distance")
def distance_ladder(f):
    """Every rung with the edges that stand on it."""
    rungs = f.spark.createDataFrame(state.LADDER, "distance string, rung int")
    by = coupling.classified(f).groupBy("distance").agg(F.count("*").alias("edges"))
    return rungs.join(by, "distance", "left").fillna(0, ["edges"])


SCOPED = ["'src/a' || k || '.go'", "'vendor/a' || k || '.go'", "'x/build/a' || k || '.py'", "'x/build' || k || '.py'", "'reports/r' || k", "'gen/a' || k || '.cs'", "'src/lib/b' || k || '.rs'", "'gen' || k || '/a.ts'"]


@query("scope_files", "WITH p AS (SELECT page_id AS k, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {p.replace('k', 'page_id')}" for i, p in enumerate(SCOPED)) + " END AS file FROM pages) SELECT k, file, k % 8 IN (1, 2, 5, 6) AS out_of_scope, CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) END AS below FROM p")
def scope_files(f):
    made = F.array(*(F.expr(p.replace("k", "cast(page_id AS string)")) for p in SCOPED))
    p = f.pages.select("page_id", F.col("page_id").alias("k"), made[(F.col("page_id") % 8).cast("int")].alias("file")).drop("page_id")
    globs = scope.exclusions(["gen/**", "!reports"])
    below = scope.rebased(p.select("k", "file"), "src").withColumnRenamed("file", "below")
    return p.withColumn("out_of_scope", scope.out_of_scope(F.col("file"), globs, ["rust"])).join(below, "k", "left")


@query("module_by_key", """WITH p AS (SELECT doc_id AS k, doc_id % 5 AS m FROM documents) SELECT DISTINCT CASE m WHEN 0 THEN 'app/core/a' || k || '.py' WHEN 1 THEN 'app/core/__init__.py' WHEN 2 THEN 'svc/x/a' || k || '.go' WHEN 3 THEN 'web/a' || k || '.ts' ELSE 'app/other/a' || k || '.py' END AS file, CASE WHEN m < 2 THEN 'core' WHEN m = 2 THEN 'svc' WHEN m = 3 THEN 'web' END AS module FROM p""")
def module_by_key(f):
    k, m = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    file = F.when(m == 0, F.concat(F.lit("app/core/a"), k, F.lit(".py"))).when(m == 1, "app/core/__init__.py").when(m == 2, F.concat(F.lit("svc/x/a"), k, F.lit(".go"))).when(m == 3, F.concat(F.lit("web/a"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("app/other/a"), k, F.lit(".py")))
    paths = paths_table(f.spark, [("core", "app.core*"), ("svc", "svc/x"), ("web", "web/**")])
    return scope.module_of_file(f.documents.select(file.alias("file")), paths)


@query("edges_at", """SELECT n_name AS node, 'from' AS side, from_module AS "from", to_module AS "to", file, line FROM {:uses} u JOIN nation ON n_name = from_module WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'to', from_module, to_module, file, line FROM {:uses} u JOIN nation ON n_name = to_module WHERE n_regionkey = 1""")
def edges_at(f):
    edges = f.uses.select(F.col("from_module").alias("from"), F.col("to_module").alias("to"), "file", "line")
    return scope.edges_at(edges, f.nation.where("n_regionkey = 1").select(F.col("n_name").alias("node")))
