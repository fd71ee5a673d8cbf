"""Uses and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import directory
from ..functions.globs import glob_regex
from ..operators import judge as J
from ..operators import rules as R
from ..operators import uses as U
from .registry import Facts, query

NUMS = range(25)
GLOBS = [(f"NATION_{i}", f"src/nation_{i}/**") for i in NUMS if i != 24] + [(f"NATION_{(i + 1) % 25}", f"src/nation_{i}/api/**") for i in NUMS if i % 5 == 0] + [("NATION_9", "src/nation_3/api/**"), ("NATION_7", "src/nation_3/api/**"), ("NATION_1", "lib/{a,b}/*.go"), ("NATION_2", "src/nation_2?/impl/g[01].go")]
FILES = "SELECT DISTINCT file FROM (SELECT file FROM {:uses} u UNION ALL SELECT target FROM {:uses} u) f"
PATHS = "(VALUES " + ", ".join(f"('{m}', '{g}', '{glob_regex(g)}', {U.specificity(g)})" for m, g in GLOBS) + ') p(module, "glob", regex, spec)'
DENY = [(0, "no-teens", "^NATION_1[0-9]$", "^NATION_2[0-9]$"), (1, "no-seven", "^NATION_7$", "^NATION_[1-5]$")]
DENIED = "(VALUES " + ", ".join(f"({p}, '{i}', '{a}', '{b}')" for p, i, a, b in DENY) + ") d(pos, id, from_regex, to_regex)"
ONLY = [("brand-1", "Brand#1", "^NATION_[0-5]$"), ("brand-2", "Brand#2", "^NATION_1[0-9]$")]
ALLOWED = "(VALUES " + ", ".join(f"('{i}', '{a}', '{b}')" for i, a, b in ONLY) + ") o(id, root, in_regex)"
LIBS = "SELECT u.*, p_brand || '/' || p_type AS library FROM {:uses} u JOIN part ON part = p_partkey"


def files(f: Facts):
    return f.uses.select("file", "target").distinct().select(F.explode(F.array("file", "target")).alias("file")).distinct()


def paths(f: Facts):
    return U.paths_table(f.spark, GLOBS)


def owned(f: Facts):
    return U.module_of(files(f), paths(f)).withColumn("production", ~F.col("file").contains("/g4"))


OWNER = f"SELECT file, module, file NOT LIKE '%/g4%' AS production FROM (SELECT f.file, p.module, row_number() OVER (PARTITION BY f.file ORDER BY p.spec DESC, p.module) AS r FROM ({FILES}) f LEFT JOIN {PATHS} ON regexp_matches(f.file, p.regex)) WHERE r = 1"


@query("module_of", f"SELECT file, module FROM ({OWNER})")
def module_of(f):
    return U.module_of(files(f), paths(f))


@query("glob_filter", f'SELECT f.file, p."glob" FROM ({FILES}) f JOIN {PATHS} ON regexp_matches(f.file, p.regex)')
def glob_filter(f):
    return U.glob_matches(files(f), paths(f)).select("file", "glob")


@query("ownership_ties", f"""WITH h AS (SELECT f.file, p.module, rank() OVER (PARTITION BY f.file ORDER BY p.spec DESC) AS r FROM ({FILES}) f JOIN {PATHS} ON regexp_matches(f.file, p.regex)),
t AS (SELECT DISTINCT file, module FROM h WHERE r = 1)
SELECT a.module AS module_a, b.module AS module_b, min(a.file) AS first_file, count(*)::BIGINT AS files FROM t a JOIN t b ON a.file = b.file AND a.module < b.module GROUP BY ALL""")
def ownership_ties(f):
    return U.ownership_ties(files(f), paths(f))


@query("dead_globs", f'SELECT p.module, p."glob" FROM {PATHS} WHERE NOT EXISTS (SELECT 1 FROM ({FILES}) f WHERE regexp_matches(f.file, p.regex))')
def dead_globs(f):
    return U.dead_globs(files(f), paths(f))


@query("uses", f"""WITH o AS ({OWNER}), d AS (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS dir FROM o)
SELECT u.file, u.line, a.module AS from_owner, CASE WHEN b.file IS NOT NULL THEN 'file' WHEN d.dir IS NOT NULL THEN 'directory' ELSE 'library' END AS kind, b.module AS to_owner
FROM (SELECT DISTINCT file, line, CASE WHEN line % 3 = 0 THEN regexp_replace(target, '/[^/]*$', '') WHEN line % 7 = 0 THEN 'ext/' || target ELSE target END AS target FROM {{:uses}} x) u
LEFT JOIN o a ON u.file = a.file LEFT JOIN o b ON u.target = b.file LEFT JOIN d ON u.target = d.dir""")
def uses(f):
    target = F.when(F.col("line") % 3 == 0, directory(F.col("target"))).when(F.col("line") % 7 == 0, F.concat(F.lit("ext/"), "target")).otherwise(F.col("target"))
    u = f.uses.select("file", "line", target.alias("target")).distinct()
    own = owned(f).select("file", "module")
    dirs = own.select(directory(F.col("file")).alias("target")).distinct().withColumn("is_dir", F.lit(True))
    out = u.join(own.withColumnRenamed("module", "from_owner"), "file", "left").join(own.select(F.col("file").alias("target"), F.col("module").alias("to_owner"), F.lit(True).alias("is_file")), "target", "left").join(dirs, "target", "left")
    return out.select("file", "line", "from_owner", F.when(F.col("is_file"), "file").when(F.col("is_dir"), "directory").otherwise("library").alias("kind"), "to_owner")


@query("dir_end", f"""WITH o AS ({OWNER}), g AS (SELECT regexp_replace(file, '/[^/]*$', '') AS dir, count(*) FILTER (production) AS n, count(DISTINCT module) FILTER (production) AS np, min(module) FILTER (production) AS p, count(DISTINCT module) AS nq, min(module) AS q, count(*)::BIGINT AS files FROM o GROUP BY 1)
SELECT dir, CASE WHEN n > 0 THEN CASE WHEN np = 1 THEN p END ELSE CASE WHEN nq = 1 THEN q END END AS module, files FROM g""")
def dir_end(f):
    return U.dir_ends(owned(f))


@query("longest_prefix", """WITH t AS (SELECT DISTINCT target AS path FROM {:uses} u), p AS (SELECT DISTINCT CASE WHEN line % 2 = 0 THEN regexp_replace(target, '/[^/]*$', '') ELSE regexp_replace(target, '/[^/]*/[^/]*$', '') END AS prefix FROM {:uses} u)
SELECT path, max_by(prefix, length(prefix)) AS prefix FROM t LEFT JOIN p ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""")
def longest_prefix(f):
    u = f.uses
    p = u.select(F.when(F.col("line") % 2 == 0, directory(F.col("target"))).otherwise(F.regexp_replace("target", "/[^/]*/[^/]*$", "")).alias("prefix")).distinct()
    return U.longest_prefix(u.select(F.col("target").alias("path")).distinct(), p)


def _errors(sql: str) -> str:
    return f'SELECT rule, "from", "to", file, line FROM ({sql})'


GRAPH = """SELECT 'graph' AS rule, from_module AS "from", to_module AS "to", file, line FROM {:uses} u WHERE from_module <> to_module AND NOT EXISTS (SELECT 1 FROM {:depends_on} d WHERE d.module = from_module AND d.target = to_module)"""
VOL = "coalesce(volatility, CASE WHEN lower(subdomain) = 'core' THEN 'high' WHEN lower(subdomain) IN ('supporting', 'generic') THEN 'low' END, 'high')"
RANK = "CASE {} WHEN 'frozen' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 5 ELSE 4 END"
V = "CASE {} WHEN 'frozen' THEN 1 WHEN 'low' THEN 3 WHEN 'medium' THEN 6 ELSE 10 END"
S = "CASE {} WHEN 'contract' THEN 1 WHEN 'model' THEN 3 WHEN 'functional' THEN 8 WHEN 'symmetric' THEN 9 WHEN 'intrusive' THEN 10 END"
COUPLED = f"""SELECT *, least(greatest(greatest(abs({S.format('strength')} - 9), 10 - {V.format('vol')}) + 1, 1), 10)::INT AS balance FROM (
  SELECT *, CASE WHEN strength = 'contract' THEN to_v WHEN {RANK.format('from_v')} > {RANK.format('to_v')} THEN from_v ELSE to_v END AS vol FROM (
    SELECT u.*, CASE WHEN public THEN 'contract' ELSE 'functional' END AS strength, a.v AS from_v, b.v AS to_v FROM {{:uses}} u
    JOIN (SELECT module, {VOL} AS v FROM {{:modules}} m) a ON a.module = from_module JOIN (SELECT module, {VOL} AS v FROM {{:modules}} m) b ON b.module = to_module WHERE from_module <> to_module))"""
COUPLING = f"""SELECT 'coupling' AS rule, from_module AS "from", to_module AS "to", file, line FROM ({COUPLED}) WHERE balance < 7"""
LAYERS = """SELECT 'layers' AS rule, from_module AS "from", to_module AS "to", file, line FROM {:uses} u JOIN {:modules} a ON a.module = from_module JOIN {:modules} b ON b.module = to_module WHERE from_module <> to_module AND a.layer_pos < b.layer_pos"""
DENYS = f"""SELECT id AS rule, from_module AS "from", to_module AS "to", file, line FROM {{:uses}} u JOIN {DENIED} ON regexp_matches(from_module, from_regex) AND regexp_matches(to_module, to_regex) WHERE from_module <> to_module"""
ONLYS = f"""SELECT id AS rule, from_module AS "from", root AS "to", file, line FROM ({LIBS}) l JOIN {ALLOWED} ON (library = root OR starts_with(library, root || '/')) AND NOT regexp_matches(from_module, in_regex)"""
UNOWNED = f"""SELECT 'unowned' AS rule, file AS "from", '' AS "to", file, 0::BIGINT AS line FROM ({OWNER}) o WHERE production AND module IS NULL"""
OTHER = r"""NOT regexp_matches(value, '^([\p{L}\p{N}_]+:"[^"]*"\s*)+$') AND NOT regexp_matches(value, '^[\p{L}\p{N}_.:@-]+$')"""
DUPLICATION = f"""SELECT 'duplication' AS rule, p.a AS "from", p.b AS "to", l.file, 0::BIGINT AS line, l.value FROM {{:literals}} l JOIN (SELECT value, min(module) AS a, max(module) AS b FROM {{:literals}} x WHERE {OTHER} AND class = 'production' GROUP BY value HAVING count(DISTINCT module) = 2) p USING (value) WHERE l.class = 'production'"""


def libraries(f: Facts):
    return f.uses.join(f.part.select(F.col("p_partkey").alias("part"), F.concat("p_brand", F.lit("/"), "p_type").alias("library")), "part")


def denied(f: Facts):
    return U.policy_table(f.spark, DENY, "pos int, id string, from_regex string, to_regex string")


def allowed(f: Facts):
    return U.policy_table(f.spark, ONLY, "id string, root string, in_regex string")


BY_KEY = 'SELECT rule, "from", "to", count(*)::BIGINT AS sites, min(struct_pack(f := file, l := line)).f AS first_file, min(struct_pack(f := file, l := line)).l AS first_line FROM (SELECT DISTINCT rule, "from", "to", file, line FROM ({})) GROUP BY ALL'


@query("rule_graph", BY_KEY.format(GRAPH))
def rule_graph(f):
    return R.errors_by_key(R.graph(f.uses, f.depends_on))


@query("errors_by_key", BY_KEY.format(LAYERS))
def errors_by_key(f):
    return R.errors_by_key(R.layers(f.uses, f.modules))


@query("rule_coupling", _errors(COUPLING))
def rule_coupling(f):
    return R.coupling(f.uses, f.modules)


@query("rule_layers", _errors(LAYERS))
def rule_layers(f):
    return R.layers(f.uses, f.modules)


@query("rule_deny", _errors(DENYS))
def rule_deny(f):
    return R.deny(f.uses, denied(f), f.modules)


@query("rule_only", _errors(ONLYS))
def rule_only(f):
    return R.only(libraries(f), allowed(f))


@query("rule_unowned", _errors(UNOWNED))
def rule_unowned(f):
    return R.unowned(owned(f))


@query("rule_duplication", DUPLICATION)
def rule_duplication(f):
    return R.duplication(f.literals)


ALL = f"{_errors(GRAPH)} UNION ALL {_errors(COUPLING)} UNION ALL {_errors(LAYERS)} UNION ALL {_errors(DENYS)} UNION ALL {_errors(ONLYS)} UNION ALL {_errors(UNOWNED)} UNION ALL {_errors(DUPLICATION)}"


@query("judge_all", BY_KEY.format(ALL))
def judge_all(f):
    off = {"cycle": "off", "unowned": "off"}  # files of targets count as well here
    uses = libraries(f).withColumns({c: F.lit(True) for c in J.MASK})
    used = J.sites(uses, J.compiled(f.modules, f.depends_on, denied(f), allowed(f)), off)
    used = used.groupBy("rule", "from", "to").agg(F.sum("head_sites").alias("sites"), F.min(F.struct("file", "line")).alias("s"))
    used = used.select("rule", "from", "to", "sites", F.col("s.file").alias("first_file"), F.col("s.line").alias("first_line"))
    # no use has an error of these rules
    return used.unionByName(R.errors_by_key(R.unowned(owned(f)).unionByName(R.duplication(f.literals).drop("value"))))


PUBLIC = [("NATION_1", "src/nation_1/api/**"), ("NATION_2", "src/nation_2/api"), ("NATION_6", "src/nation_6/{api,impl}/g[0-2].go")]
PUBLICS = "(VALUES " + ", ".join(f"('{m}', '{glob_regex(g)}')" for m, g in PUBLIC) + ") q(module, regex)"


@query("public_use", f"""SELECT file, line, target, to_module, NOT EXISTS (SELECT 1 FROM {PUBLICS} WHERE module = to_module) OR EXISTS (SELECT 1 FROM {PUBLICS} WHERE module = to_module AND (regexp_matches(target, regex) OR regexp_matches(regexp_replace(target, '/[^/]*$', ''), regex))) AS is_public FROM {{:uses}} u""")
def public_use(f):
    return U.public_use(f.uses.select("file", "line", "target", "to_module"), U.paths_table(f.spark, PUBLIC))


@query("package_set_use", f"SELECT DISTINCT library, root FROM ({LIBS}) l JOIN {ALLOWED} ON library = root OR starts_with(library, root || '/')")
def package_set_use(f):
    return libraries(f).select("library", F.explode(U.ancestors(F.col("library"))).alias("root")).distinct().join(allowed(f), "root").select("library", "root")


@query("language_of", "SELECT DISTINCT url, CASE regexp_extract(url, '\\.([a-z0-9]+)(?:[?#].*)?$', 1) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'dotnet' ELSE 'unknown' END AS language FROM (SELECT url FROM pages UNION ALL SELECT target FROM {:uses} u) x")
def language_of(f):
    from ..functions.columns import pick

    x = f.pages.select("url").unionAll(f.uses.select(F.col("target").alias("url"))).distinct()
    ext = F.regexp_extract("url", r"\.([a-z0-9]+)(?:[?#].*)?$", 1)
    return x.select("url", pick(ext, {"go": "go", "py": "python", "ts": "typescript", "rs": "rust", "cs": "dotnet"}, "unknown").alias("language"))


@query("dependency_edges", "SELECT from_module, to_module, kind, count(*)::BIGINT AS n FROM (SELECT *, CASE flag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'depends_on' ELSE 'contains' END AS kind FROM {:uses} u) WHERE kind IN ('imports', 'depends_on', 'uses_internal') GROUP BY ALL")
def dependency_edges(f):
    kind = F.when(F.col("flag") == "A", "imports").when(F.col("flag") == "N", "depends_on").otherwise("contains")
    return f.uses.withColumn("kind", kind).where(F.col("kind").isin("imports", "depends_on", "uses_internal")).groupBy("from_module", "to_module", "kind").agg(F.count("*").alias("n"))


@query("node_path", "SELECT DISTINCT 'file:' || target AS id, target AS path, regexp_replace(target, '/[^/]*$', '') AS module_key FROM {:uses} u")
def node_path(f):
    node = f.uses.select(F.concat(F.lit("file:"), "target").alias("id")).distinct()
    path = F.expr("substring(id, instr(id, ':') + 1)")
    return node.select("id", path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("module_key"))


@query("facts_tidy", "SELECT DISTINCT file, line, target FROM {:uses} u WHERE NOT regexp_matches(file, '/f0\\.go$') UNION ALL SELECT file, min(line) AS line, 'parse failure' AS target FROM {:uses} u WHERE qty > 48 AND NOT regexp_matches(file, '/f0\\.go$') GROUP BY file")
def facts_tidy(f):
    u = f.uses.where(~F.col("file").rlike(r"/f0\.go$"))
    bad = u.where("qty > 48").groupBy("file").agg(F.min("line").alias("line")).withColumn("target", F.lit("parse failure"))
    return u.select("file", "line", "target").distinct().unionByName(bad)


@query("literal_index", "SELECT value, count(*)::BIGINT AS places, count(DISTINCT module)::BIGINT AS modules FROM {:literals} l GROUP BY value")
def literal_index(f):
    return f.literals.groupBy("value").agg(F.count("*").alias("places"), F.count_distinct("module").alias("modules"))


@query("literal_shape", r"""SELECT value, CASE WHEN regexp_matches(value, '^([\p{L}\p{N}_]+:"[^"]*"\s*)+$') THEN 'tag' WHEN regexp_matches(value, '^[\p{L}\p{N}_.:@-]+$') THEN 'word' ELSE 'other' END AS shape FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS value FROM documents) WHERE length(value) >= 12""")
def literal_shape(f):
    return f.documents.select(F.explode(F.split("text", " ")).alias("value")).distinct().where(F.length("value") >= 12).select("value", R.shape(F.col("value")).alias("shape"))


@query("edge_imports", "SELECT DISTINCT file, line::BIGINT AS line, target FROM {:uses} u")
def edge_imports(f):
    edges = f.uses.groupBy("file", "target").agg(F.collect_set("line").alias("lines"))
    return edges.select("file", F.explode_outer("lines").alias("line"), "target").fillna(0, ["line"])


@query("denied_dependency", """SELECT from_module, to_module, (CASE WHEN d.module IS NULL THEN 'depends_on' ELSE '' END) || (CASE WHEN from_num % 5 = 0 THEN '+visible_to' ELSE '' END) AS denied_by FROM (SELECT DISTINCT from_module, to_module, from_num FROM {:uses} u WHERE from_module <> to_module) p LEFT JOIN {:depends_on} d ON d.module = from_module AND d.target = to_module WHERE d.module IS NULL OR from_num % 5 = 0""")
def denied_dependency(f):
    pair = f.uses.where("from_module <> to_module").select("from_module", "to_module", "from_num").distinct()
    known = f.depends_on.select(F.col("module").alias("from_module"), F.col("target").alias("to_module"), F.lit(True).alias("ok"))
    out = pair.join(known, ["from_module", "to_module"], "left").withColumn("hidden", F.col("from_num") % 5 == 0)
    by = F.concat(F.when(F.col("ok").isNull(), "depends_on").otherwise(""), F.when(F.col("hidden"), "+visible_to").otherwise(""))
    return out.where("ok IS NULL OR hidden").select("from_module", "to_module", by.alias("denied_by"))


SELECTORS = ["layer:ASIA", "layer:REGION_1", "role:facade", "NATION_1*", "NATION_?"]
SELECT = "(VALUES " + ", ".join(f"('{s}', '{glob_regex(s)}')" for s in SELECTORS) + ") s(selector, regex)"


@query("module_select", f"SELECT selector, module FROM {SELECT} JOIN {{:modules}} m ON CASE WHEN starts_with(selector, 'layer:') THEN layer = substr(selector, 7) WHEN starts_with(selector, 'role:') THEN role = substr(selector, 6) ELSE regexp_matches(module, regex) END")
def module_select(f):
    s = f.spark.createDataFrame([(x, glob_regex(x)) for x in SELECTORS], "selector string, regex string")
    on = F.expr("CASE WHEN startswith(selector, 'layer:') THEN layer = substring(selector, 7) WHEN startswith(selector, 'role:') THEN role = substring(selector, 6) ELSE module RLIKE regex END")
    return f.modules.join(s, on).select("selector", "module")


@query("allowed_balances", f"SELECT from_module, to_module, min(balance)::INT AS worst, count(*)::BIGINT AS uses FROM ({COUPLED}) JOIN {{:depends_on}} d ON d.module = from_module AND d.target = to_module GROUP BY ALL")
def allowed_balances(f):
    ok = f.depends_on.select(F.col("module").alias("from_module"), F.col("target").alias("to_module"))
    return R.coupled(f.uses, f.modules).join(ok, ["from_module", "to_module"]).groupBy("from_module", "to_module").agg(F.min("balance").alias("worst"), F.count("*").alias("uses"))


