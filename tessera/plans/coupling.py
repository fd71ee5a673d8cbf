"""Classification, scores and rollups of the module graph's edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import DISTANCE_RANK, STRENGTH_RANK, VOLATILITY_RANK, pick, severity
from ..operators import classify as C
from .registry import Facts, query
from .rules import RANK

VOL = "CASE WHEN volatility IS NOT NULL THEN volatility WHEN lower(subdomain) = 'core' THEN 'high' WHEN lower(subdomain) IN ('supporting', 'generic') THEN 'low' ELSE 'undeclared' END"
MODS = f"(SELECT module, owner, deploy_unit, role, layer, subdomain, {VOL} AS vol FROM {{:modules}} m)"
HINT = "CASE WHEN qty > 46 THEN 'intrusive' ELSE hint END"
STRENGTH = f"CASE WHEN public AND qty % 2 = 0 AND {HINT} = 'intrusive' THEN 'intrusive' WHEN public AND qty % 2 = 0 AND qty % 7 = 0 THEN 'model' WHEN public AND qty % 2 = 0 THEN 'contract' WHEN qty = 45 THEN 'intrusive' ELSE {HINT} END"
DISTANCE = "CASE WHEN from_module = to_module THEN 'same_module' WHEN a.deploy_unit <> b.deploy_unit THEN 'different_deploy_unit' WHEN a.owner <> b.owner THEN 'different_owner' ELSE 'cross_module' END"
ORD_S = "CASE strength WHEN 'contract' THEN 1 WHEN 'model' THEN 3 WHEN 'functional' THEN 8 WHEN 'symmetric' THEN 9 WHEN 'intrusive' THEN 10 END"
ORD_D = "CASE distance WHEN 'same_module' THEN 2 WHEN 'unknown' THEN NULL ELSE 9 END"
ORD_V = "CASE vol WHEN 'frozen' THEN 1 WHEN 'low' THEN 3 WHEN 'medium' THEN 6 ELSE 10 END"
BASE = f"""c0 AS (SELECT e.*, {STRENGTH} AS strength, {DISTANCE} AS distance, a.vol AS from_vol, b.vol AS to_vol, a.role AS from_role, b.role AS to_role, a.owner AS from_owner, b.owner AS to_owner, b.subdomain AS to_subdomain FROM {{:edges}} e LEFT JOIN {MODS} a ON a.module = from_module LEFT JOIN {MODS} b ON b.module = to_module),
c1 AS (SELECT *, CASE WHEN strength IN ('functional', 'symmetric') AND {RANK.format('from_vol')} > {RANK.format('to_vol')} THEN from_vol ELSE to_vol END AS vol FROM c0),
c2 AS (SELECT *, {ORD_S} AS s, {ORD_D} AS d, {ORD_V} AS v FROM c1),
c3 AS (SELECT *, CASE WHEN s IS NULL OR d IS NULL THEN NULL ELSE least(greatest(greatest(abs(s - d), 10 - v) + 1, 1), 10) END::INT AS balance FROM c2),
c AS (SELECT *, CASE WHEN balance <= 2 THEN 'critical' WHEN balance <= 4 THEN 'high' WHEN balance <= 6 THEN 'medium' WHEN balance <= 8 THEN 'low' WHEN balance IS NOT NULL THEN '' END AS severity, distance IN ('cross_module', 'different_owner', 'different_deploy_unit') AS boundary FROM c3)"""
W = "WITH " + BASE
MONO = "balance IS NOT NULL AND boundary AND vol = 'high' AND (strength = 'intrusive' OR (strength IN ('functional', 'symmetric') AND to_role NOT IN ('facade', 'shared_kernel')))"


def classified(f: Facts):
    return C.classified(f.edges, f.modules)


ID = "from_module, to_module, file, line"
IDS = ["from_module", "to_module", "file", "line"]


@query("classify_edges", f"{W} SELECT {ID}, strength, distance, vol, balance, severity, CASE WHEN strength IN ('contract', 'model') THEN 'explicit' ELSE 'implicit' END AS explicitness FROM c")
def classify_edges(f):
    return classified(f).select(*IDS, "strength", "distance", "vol", "balance", "severity", "explicitness")


@query("classify_strength", f"{W} SELECT {ID}, strength FROM c")
def classify_strength(f):
    return classified(f).select(*IDS, "strength")


@query("classify_distance", f"{W} SELECT {ID}, distance FROM c")
def classify_distance(f):
    return classified(f).select(*IDS, "distance")


@query("classify_volatility", f"{W} SELECT {ID}, from_vol, to_vol, vol FROM c")
def classify_volatility(f):
    return classified(f).select(*IDS, "from_vol", "to_vol", "vol")


CUBE_S, CUBE_D, CUBE_V = list(STRENGTH_RANK), list(DISTANCE_RANK), ["frozen", "low", "medium", "high", "undeclared", "unknown"]


def _values(xs: list[str], name: str) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in xs) + f") {name}({name})"


CELL = "strength, distance, vol"


def cells(f: Facts, *more):
    """How many edges have each combination of strength, distance and volatility."""
    return C.ordinals(classified(f).groupBy("strength", "distance", "vol", *more).agg(F.count("*").alias("edges")))


@query("book_score", f"{W} SELECT {CELL}, balance, count(*)::BIGINT AS edges FROM c GROUP BY ALL")
def book_score(f):
    return cells(f).select("strength", "distance", "vol", C.balance(F.col("strength"), F.col("distance"), F.col("vol")).cast("int").alias("balance"), "edges")


def _ranks(name: str, table: dict, lower: dict, keys: list[str], default=0) -> str:
    """VALUES of a dimension: its key, its number, and the key one step lower."""
    rows = ", ".join(f"('{k}', {table.get(k, default)}, {repr(lower[k]) if k in lower else 'NULL'})" for k in keys)
    return f"(VALUES {rows}) {name}(k, n, low)"


def _scored(score: str, weights: dict) -> str:
    """Score and cheapest move of the cells that edges have, by joining every cell with its neighbours one step lower."""
    rs, rd, rv = _ranks("s", C.RISK_STRENGTH, C.LOWER_STRENGTH, CUBE_S), _ranks("d", C.RISK_DISTANCE, C.LOWER_DISTANCE, CUBE_D), _ranks("v", weights, C.LOWER_VOLATILITY, CUBE_V)
    return f"""{W}, k AS (SELECT s.k AS strength, d.k AS distance, v.k AS vol, s.low AS ls, d.low AS ld, v.low AS lv, CASE WHEN d.k = 'same_module' THEN 0 ELSE {score} END::INT AS score FROM {rs}, {rd}, {rv}),
b AS (SELECT *, CASE WHEN score <= 2 THEN 0 WHEN score <= 4 THEN 1 WHEN score <= 6 THEN 2 WHEN score <= 8 THEN 3 ELSE 4 END AS band FROM k),
m AS (SELECT x.*, greatest(0, x.band - coalesce(s.band, 9)) AS a, greatest(0, x.band - coalesce(d.band, 9)) AS b, greatest(0, x.band - coalesce(v.band, 9)) AS c FROM b x LEFT JOIN b s ON (s.strength, s.distance, s.vol) = (x.ls, x.distance, x.vol) LEFT JOIN b d ON (d.strength, d.distance, d.vol) = (x.strength, x.ld, x.vol) LEFT JOIN b v ON (v.strength, v.distance, v.vol) = (x.strength, x.distance, x.lv))
SELECT {CELL}, score, CASE WHEN a + b + m.c = 0 THEN '' WHEN a >= b AND a >= m.c THEN 'reduce_strength' WHEN b >= m.c THEN 'reduce_distance' WHEN vol = 'undeclared' THEN 'declare_volatility' ELSE 'lower_volatility' END AS move, edges FROM m JOIN (SELECT {CELL}, count(*)::BIGINT AS edges FROM c GROUP BY ALL) n USING ({CELL})"""


def _scores(f: Facts, score):
    """Scores of all cells are a table of fixed size, which the cells of edges look up."""
    k = (F.col("strength"), F.col("distance"), F.col("vol"))
    cube = f.spark.createDataFrame([(s, d, v) for s in CUBE_S for d in CUBE_D for v in CUBE_V], "strength string, distance string, vol string")
    table = cube.select(*k, score(*k).cast("int").alias("score"), C.cheapest_move(score, *k).alias("move"))
    return cells(f).join(F.broadcast(table), ["strength", "distance", "vol"]).select(*k, "score", "move", "edges")


@query("additive_score", _scored("least(10, greatest(0, s.n + d.n - v.n))", C.DISCOUNT))
def additive_score(f):
    return _scores(f, C.additive)


@query("multiplicative_score", _scored("greatest(CASE WHEN s.k = 'intrusive' THEN 3 ELSE 0 END, round(10 * ((1 - abs(s.n / 8.0::DOUBLE - least(d.n / 5.0::DOUBLE, 1))) * v.n::DOUBLE)))", C.WEIGHT))
def multiplicative_score(f):
    return _scores(f, C.multiplicative)


HYPO = """CASE WHEN balance IS NULL THEN '' WHEN balance > 6 THEN CASE WHEN strength IN ('functional', 'symmetric', 'intrusive') THEN 'accept_low_volatility' ELSE 'balanced' END
  WHEN cohesive AND strength <> 'intrusive' THEN 'expected_by_role' WHEN vol IN ('undeclared', 'unknown') THEN 'declare_volatility' WHEN strength = 'intrusive' THEN 'introduce_contract' WHEN strength = 'symmetric' THEN 'move_functionality'
  WHEN strength IN ('functional', 'model') THEN CASE WHEN public THEN 'introduce_contract' ELSE 'move_functionality' END ELSE '' END"""


@query("hypothesis", f"{W} SELECT {CELL}, public, cohesive, {HYPO} AS hypothesis, count(*)::BIGINT AS edges FROM (SELECT *, to_role IN ('facade', 'shared_kernel') AS cohesive FROM c) GROUP BY ALL")
def hypothesis(f):
    k = cells(f, "public", F.col("to_role").isin("facade", "shared_kernel").alias("cohesive"))
    band = C.balance(F.col("strength"), F.col("distance"), F.col("vol"))
    move = C.hypothesis(F.col("strength"), F.col("vol"), severity(band), F.col("public"), F.col("cohesive"))
    return k.select("strength", "distance", "vol", "public", "cohesive", move.alias("hypothesis"), "edges")


@query("balance_driver", f"{W} SELECT {CELL}, CASE WHEN abs(s - d) > 10 - v THEN 'strength_distance' WHEN abs(s - d) < 10 - v THEN 'volatility' ELSE 'tie' END AS driver, count(*)::BIGINT AS edges FROM c WHERE s IS NOT NULL AND d IS NOT NULL AND distance <> 'same_module' GROUP BY ALL")
def balance_driver(f):
    gap = F.abs(F.col("s") - F.col("d"))
    scored = cells(f).where("s IS NOT NULL AND d IS NOT NULL AND distance <> 'same_module'")
    return scored.select("strength", "distance", "vol", F.when(gap > 10 - F.col("v"), "strength_distance").when(gap < 10 - F.col("v"), "volatility").otherwise("tie").alias("driver"), "edges")


@query("contract_recommended", f"{W} SELECT {ID} FROM c WHERE strength <> 'contract' AND distance <> 'same_module' AND lower(to_subdomain) = 'generic'")
def contract_recommended(f):
    return classified(f).where((F.col("strength") != "contract") & (F.col("distance") != "same_module") & (F.lower("to_subdomain") == "generic")).select(*IDS)


SR = "CASE strength WHEN 'contract' THEN 1 WHEN 'model' THEN 2 WHEN 'functional' THEN 3 WHEN 'symmetric' THEN 4 WHEN 'intrusive' THEN 5 ELSE 0 END"
DR = "CASE distance WHEN 'same_module' THEN 1 WHEN 'cross_module' THEN 2 WHEN 'different_owner' THEN 3 WHEN 'different_deploy_unit' THEN 4 ELSE 0 END"


@query("seams", f"""{W}, k AS (SELECT *, {SR} AS sr, {DR} AS dr, {RANK.format('vol')} AS vr, {MONO} AS mono, row_number() OVER (PARTITION BY from_module, to_module ORDER BY balance NULLS LAST, {SR} DESC, {DR} DESC, file, line) AS r FROM c WHERE boundary)
SELECT from_module, to_module, count(*)::BIGINT AS edges, count(balance)::BIGINT AS scored, max(sr)::INT AS worst_strength, max(dr)::INT AS worst_distance, max(vr)::INT AS worst_volatility, min(balance)::INT AS worst_balance,
count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'high')::BIGINT AS high, count(*) FILTER (mono)::BIGINT AS qualifying, (100 * count(*) FILTER (mono) // count(*))::BIGINT AS share_pct, max(CASE WHEN r = 1 THEN file || ':' || line END) AS worst_edge,
CASE WHEN count(balance) = 0 THEN 'unrated' WHEN count(*) - count(balance) > count(balance) THEN 'low' WHEN count(balance) < count(*) THEN 'medium' ELSE 'high' END AS confidence FROM k GROUP BY from_module, to_module""")
def seams(f):
    e = classified(f).where(C.boundary(F.col("distance"))).withColumn("mono", C.monolith())
    e = e.withColumns({"sr": pick(F.col("strength"), STRENGTH_RANK, 0), "dr": pick(F.col("distance"), DISTANCE_RANK, 0), "vr": pick(F.col("vol"), VOLATILITY_RANK, 4)})
    n, scored = F.count("*"), F.count("balance")
    worst = F.min_by(F.concat("file", F.lit(":"), F.col("line").cast("string")), F.struct(F.coalesce("balance", F.lit(99)), -F.col("sr"), -F.col("dr"), "file", "line"))
    return e.groupBy("from_module", "to_module").agg(
        n.alias("edges"), scored.alias("scored"), F.max("sr").alias("worst_strength"), F.max("dr").alias("worst_distance"), F.max("vr").alias("worst_volatility"), F.min("balance").alias("worst_balance"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if("mono").alias("qualifying"), F.expr("100 * count_if(mono) div count(*)").alias("share_pct"), worst.alias("worst_edge"),
        F.when(scored == 0, "unrated").when(n - scored > scored, "low").when(scored < n, "medium").otherwise("high").alias("confidence"),
    )


@query("seam_scores", f"""{W} SELECT from_module, to_module, count(balance)::BIGINT AS n, min(balance)::INT AS low, quantile_disc(balance, 0.5)::INT AS median, max(balance)::INT AS high, CASE WHEN count(balance) >= 10 THEN quantile_disc(balance, 0.1) END::INT AS p10, CASE WHEN count(balance) >= 10 THEN quantile_disc(balance, 0.9) END::INT AS p90, round(avg(balance), 6) AS mean FROM c WHERE boundary AND balance IS NOT NULL GROUP BY ALL""")
def seam_scores(f):
    e = classified(f).where(C.boundary(F.col("distance")) & F.col("balance").isNotNull())
    q = lambda p: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY balance) AS INT)")
    many = F.count("*") >= 10
    return e.groupBy("from_module", "to_module").agg(F.count("*").alias("n"), F.min("balance").alias("low"), q(0.5).alias("median"), F.max("balance").alias("high"), F.when(many, q(0.1)).alias("p10"), F.when(many, q(0.9)).alias("p90"), F.round(F.avg("balance"), 6).alias("mean"))


@query("edge_summary", f"{W} SELECT strength, distance, severity, grouping(strength, distance, severity)::INT AS grp, count(*)::BIGINT AS edges, round(avg(balance), 6) AS mean FROM c GROUP BY GROUPING SETS ((strength), (distance), (severity), ())")
def edge_summary(f):
    e = classified(f)
    return e.groupingSets([[F.col("strength")], [F.col("distance")], [F.col("severity")], []], F.col("strength"), F.col("distance"), F.col("severity")).agg(F.grouping_id().cast("int").alias("grp"), F.count("*").alias("edges"), F.round(F.avg("balance"), 6).alias("mean")).select("strength", "distance", "severity", "grp", "edges", "mean")


@query("tail_risk", f"""{W}, k AS (SELECT balance, severity, row_number() OVER (ORDER BY balance) AS r, count(*) OVER () AS n FROM c WHERE boundary AND balance IS NOT NULL)
SELECT min(balance)::INT AS worst, max(CASE WHEN r = (n + 9) // 10 THEN balance END)::INT AS lower_decile, round(count(*) FILTER (severity IN ('high', 'critical')) / count(*), 6) AS high_share, count(*) FILTER (severity = 'critical')::BIGINT AS criticals FROM k""")
def tail_risk(f):
    # ranks from the ten counts of the balances
    e = classified(f).where(C.boundary(F.col("distance")) & F.col("balance").isNotNull())
    h = e.groupBy("balance", "severity").agg(F.count("*").alias("k"))
    h = h.withColumn("run", F.sum("k").over(Window.orderBy("balance"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    return h.agg(F.min("balance").alias("worst"), F.min(F.when(F.col("run") >= F.expr("(n + 9) div 10"), F.col("balance"))).alias("lower_decile"), F.round(F.sum(F.when(F.col("severity").isin("high", "critical"), F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("high_share"), F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("k"))), F.lit(0)).alias("criticals"))


@query("unrated_volatility", f"{W}, x AS (SELECT unnest([from_module, to_module]) AS module, unnest([from_vol, to_vol]) AS v FROM c WHERE boundary AND (from_vol = 'undeclared' OR to_vol = 'undeclared')) SELECT module, count(*)::BIGINT AS edges FROM x WHERE v = 'undeclared' GROUP BY module")
def unrated_volatility(f):
    e = classified(f).where(C.boundary(F.col("distance")))
    ends = e.select(F.explode(F.array(F.struct(F.col("from_module").alias("module"), F.col("from_vol").alias("v")), F.struct(F.col("to_module").alias("module"), F.col("to_vol").alias("v")))).alias("x")).select("x.*")
    return ends.where("v = 'undeclared'").groupBy("module").agg(F.count("*").alias("edges"))


@query("local_coupling", f"""{W}, k AS (SELECT *, strength IN ('contract', 'model') AS complex FROM c WHERE distance = 'same_module'), o AS (SELECT from_module, line, row_number() OVER (PARTITION BY from_module ORDER BY balance, file, line) AS r FROM k WHERE severity <> '')
SELECT from_module AS module, count(balance)::BIGINT AS scored, (count(*) - count(balance))::BIGINT AS abstained, count(balance) FILTER (complex)::BIGINT AS complexity, CASE WHEN count(balance) > 0 THEN 100 * count(balance) FILTER (complex) // count(balance) ELSE 0 END::BIGINT AS share_pct, coalesce(round(avg(balance), 6), 0.0) AS mean,
(SELECT string_agg(line::STRING, ',' ORDER BY r) FROM o WHERE r <= 5 AND o.from_module = k.from_module) AS worst FROM k GROUP BY from_module""")
def local_coupling(f):
    e = classified(f).where(F.col("distance") == "same_module")
    complex_ = F.col("strength").isin("contract", "model") & F.col("balance").isNotNull()
    by = e.groupBy("from_module").agg(F.count("balance").alias("scored"), (F.count("*") - F.count("balance")).alias("abstained"), F.count_if(complex_).alias("complexity"), F.coalesce(F.round(F.avg("balance"), 6), F.lit(0.0)).alias("mean"))
    by = by.withColumn("share_pct", F.coalesce(F.expr("try_divide(100 * complexity - (100 * complexity) % nullif(scored, 0), scored)").cast("long"), F.lit(0)))
    top = F.row_number().over(Window.partitionBy("from_module").orderBy("balance", "file", "line"))
    worst = e.where("severity <> ''").select("from_module", "line", top.alias("r")).where("r <= 5").groupBy("from_module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"].cast("string")), ",").alias("worst"))
    return by.join(worst, "from_module", "left").withColumnRenamed("from_module", "module")


@query("connascence", f"{W}, x AS (SELECT DISTINCT {ID}, unnest(CASE WHEN qty % 3 = 0 THEN ['name', 'type'] WHEN qty % 3 = 1 THEN ['position'] ELSE [NULL] END) AS kind FROM c) SELECT coalesce(kind, 'abstained') AS kind, count(*)::BIGINT AS edges FROM x GROUP BY 1")
def connascence(f):
    kinds = F.when(F.col("qty") % 3 == 0, F.array(F.lit("name"), F.lit("type"))).when(F.col("qty") % 3 == 1, F.array(F.lit("position")))
    x = classified(f).select(*IDS, F.explode_outer(F.array_sort(F.array_distinct(kinds))).alias("kind")).distinct()
    return x.groupBy(F.coalesce("kind", F.lit("abstained")).alias("kind")).agg(F.count("*").alias("edges"))


@query("bc_advisories", f"{W} SELECT {ID}, severity, strength || ' use of ' || to_module || ' over ' || distance || ' scores ' || balance AS text FROM c WHERE boundary AND severity IN ('critical', 'high')")
def bc_advisories(f):
    text = F.concat("strength", F.lit(" use of "), "to_module", F.lit(" over "), "distance", F.lit(" scores "), F.col("balance").cast("string"))
    return classified(f).where(C.boundary(F.col("distance")) & F.col("severity").isin("critical", "high")).select(*IDS, "severity", text.alias("text"))


@query("bc_rollup", f"""{W}, k AS (SELECT DISTINCT from_module, to_module, strength, distance, vol, file || ':' || line AS site FROM c WHERE boundary), r AS (SELECT *, row_number() OVER (PARTITION BY from_module, to_module, strength, distance, vol ORDER BY site) AS r FROM k)
SELECT from_module, to_module, strength, distance, vol, count(*)::BIGINT AS members, string_agg(CASE WHEN r <= 8 THEN site END, ',' ORDER BY site) AS sample FROM r GROUP BY from_module, to_module, strength, distance, vol""")
def bc_rollup(f):
    k = classified(f).where(C.boundary(F.col("distance"))).select("from_module", "to_module", "strength", "distance", "vol", F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("site")).distinct()
    key = ["from_module", "to_module", "strength", "distance", "vol"]
    k = k.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("site")))
    return k.groupBy(*key).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 8, F.col("site")))), ",").alias("sample"))


@query("fingerprints", "SELECT DISTINCT from_module, to_module, sha256('seam.v1' || chr(0) || from_module || chr(0) || to_module) AS seam_id, sha256('edge' || chr(0) || from_module || chr(0) || to_module) AS finding_id FROM {:edges} e")
def fingerprints(f):
    z = F.char(F.lit(0))
    p = f.edges.select("from_module", "to_module").distinct()
    return p.select("from_module", "to_module", F.sha2(F.concat(F.lit("seam.v1"), z, "from_module", z, "to_module"), 256).alias("seam_id"), F.sha2(F.concat(F.lit("edge"), z, "from_module", z, "to_module"), 256).alias("finding_id"))


@query("volatility_provenance", "SELECT CASE WHEN volatility IS NOT NULL THEN 'declared' WHEN subdomain IS NOT NULL THEN 'inherited' ELSE 'undeclared' END AS provenance, count(*)::BIGINT AS modules, string_agg(module, ',' ORDER BY module) AS names FROM {:modules} m GROUP BY 1")
def volatility_provenance(f):
    p = F.when(F.col("volatility").isNotNull(), "declared").when(F.col("subdomain").isNotNull(), "inherited").otherwise("undeclared")
    return f.modules.groupBy(p.alias("provenance")).agg(F.count("*").alias("modules"), F.array_join(F.array_sort(F.collect_list("module")), ",").alias("names"))


SYSTEMS = [("billing", "^Brand#1"), ("ledger", "^Brand#1[0-5]/"), ("mail", "/PROMO")]
SYS = "(VALUES " + ", ".join(f"('{n}', '{r}')" for n, r in SYSTEMS) + ") s(system, regex)"


@query("external_seams", f"SELECT from_module, min_sys AS system, count(*)::BIGINT AS edges FROM (SELECT u.from_module, u.line, u.file, (SELECT min(system) FROM {SYS} WHERE regexp_matches(p_brand || '/' || p_type, regex)) AS min_sys FROM {{:uses}} u JOIN part ON part = p_partkey) WHERE min_sys IS NOT NULL GROUP BY ALL")
def external_seams(f):
    lib = f.part.select(F.col("p_partkey").alias("part"), F.concat("p_brand", F.lit("/"), "p_type").alias("library"))
    s = f.spark.createDataFrame(SYSTEMS, "system string, regex string")
    first = lib.select("library").distinct().join(s, F.expr("library RLIKE regex")).groupBy("library").agg(F.min("system").alias("system"))
    return f.uses.select("from_module", "part").join(lib, "part").join(first, "library").groupBy("from_module", "system").agg(F.count("*").alias("edges"))


@query("external_candidates", "SELECT lower(regexp_replace(p_brand, '#[0-9]+$', '')) || '/' || lower(split_part(p_type, ' ', 1)) AS candidate, count(*)::BIGINT AS edges, count(DISTINCT from_module)::BIGINT AS modules FROM {:uses} u JOIN part ON part = p_partkey GROUP BY 1")
def external_candidates(f):
    p = f.part.select(F.col("p_partkey").alias("part"), F.concat(F.lower(F.regexp_replace("p_brand", "#[0-9]+$", "")), F.lit("/"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("candidate"))
    return f.uses.select("from_module", "part").join(p, "part").groupBy("candidate").agg(F.count("*").alias("edges"), F.count_distinct("from_module").alias("modules"))


@query("top_pairs", f"{W} SELECT from_module, to_module, count(*)::BIGINT AS risky FROM c WHERE boundary AND severity IN ('critical', 'high') GROUP BY ALL ORDER BY risky DESC, from_module, to_module LIMIT 5")
def top_pairs(f):
    e = classified(f).where(C.boundary(F.col("distance")) & F.col("severity").isin("critical", "high"))
    return e.groupBy("from_module", "to_module").agg(F.count("*").alias("risky")).orderBy(F.desc("risky"), "from_module", "to_module").limit(5)
