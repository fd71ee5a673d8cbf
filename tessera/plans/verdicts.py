"""The verdict on a change: one pass over the facts of both trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judge as J
from ..operators.uses import policy_table
from .changes import ADDED, BASE, EXC, EXCEPTIONS, EXPIRED, HEAD, HOLDS, NEW, TODAY, keys, marked, policy
from .registry import Facts, query
from .rules import COUPLING, DENYS, DUPLICATION, GRAPH, LAYERS, ONLYS, OWNER, allowed, denied, libraries, paths

#: Literals of the base tree, of head, and of lines that the change adds: a change that translates French texts into German ones.
L_BASE, L_HEAD, L_NEW = "lang <> 'de'", "lang <> 'fr'", "lang = 'de'"


def masked(rows, base: str, head: str, added: str):
    """Rows of either tree."""
    return marked(rows, base, head, added).where("base OR head")


def literals(f: Facts):
    return masked(f.literals.join(f.documents.select("doc_id", "lang"), "doc_id"), L_BASE, L_HEAD, L_NEW)


def error_keys(f: Facts):
    return J.error_keys(marked(libraries(f), BASE, HEAD, NEW), literals(f), paths(f), policy(f))


def numbered(f: Facts):
    """Exceptions with their place in the policy."""
    rows = policy_table(f.spark, [(k, *x) for k, x in enumerate(EXCEPTIONS)], "pos int, rule string, `from` string, `to` string, expires string, from_regex string")
    return rows.withColumn("expires", F.to_date("expires"))


def _sides(sql: str) -> str:
    """Error sites of both trees, with the mask; sql selects rule, from, to, file and line from {:uses}."""
    out = []
    for side in ("base", "head"):
        out.append(f"""SELECT DISTINCT rule, "from", "to", file, line, '{side}' AS side FROM ({sql.replace('{:uses}', '{:' + side + '}')})""")
    return " UNION ALL ".join(out)


def _cycle(side: str) -> str:
    return f"""SELECT DISTINCT 'cycle' AS rule, u.from_module AS "from", u.to_module AS "to", file, line, '{side}' AS side FROM {{:{side}}} u JOIN r_{side} x ON x.a = u.from_module AND x.b = u.to_module JOIN r_{side} y ON y.a = u.to_module AND y.b = u.from_module WHERE u.from_module <> u.to_module"""


def _copies(side: str, where: str) -> str:
    return f"""SELECT 'duplication' AS rule, p.a AS "from", p.b AS "to", 'sha256:' || sha256(value) AS symbol, '{side}' AS side, l.file, {L_NEW} AS new FROM lits l JOIN (SELECT value, min(module) AS a, max(module) AS b FROM lits WHERE {where} GROUP BY value HAVING count(DISTINCT module) = 2) p USING (value) WHERE {where}"""


OTHER = DUPLICATION[DUPLICATION.index("NOT regexp_matches(value"):DUPLICATION.index(" AND class = 'production' GROUP BY")]
KEYS = f"""WITH RECURSIVE p_base AS (SELECT DISTINCT from_module AS a, to_module AS b FROM {{:base}} u WHERE from_module <> to_module), p_head AS (SELECT DISTINCT from_module AS a, to_module AS b FROM {{:head}} u WHERE from_module <> to_module),
r_base(a, b) AS (SELECT a, b FROM p_base UNION SELECT r_base.a, p_base.b FROM r_base JOIN p_base ON r_base.b = p_base.a), r_head(a, b) AS (SELECT a, b FROM p_head UNION SELECT r_head.a, p_head.b FROM r_head JOIN p_head ON r_head.b = p_head.a),
lits AS (SELECT l.*, d.lang FROM {{:literals}} l JOIN documents d USING (doc_id) WHERE class = 'production' AND module IS NOT NULL AND {OTHER}),
homeless AS (SELECT file FROM ({OWNER}) o WHERE module IS NULL),
sites AS ({' UNION ALL '.join(_sides(x) for x in (GRAPH, COUPLING, LAYERS, DENYS, ONLYS))} UNION ALL {_cycle('base')} UNION ALL {_cycle('head')}),
keys AS (SELECT rule, "from", "to", '' AS symbol, count(*) FILTER (side = 'base') AS base_sites, count(*) FILTER (side = 'head') AS head_sites, count(*) FILTER (side = 'head' AND a.file IS NOT NULL) AS added_sites
  FROM sites s LEFT JOIN {{:added}} a ON a.file = s.file AND a.line = s.line GROUP BY ALL
  UNION ALL SELECT 'unowned', file, '', '', max(CASE WHEN {BASE} THEN 1 ELSE 0 END), max(CASE WHEN {HEAD} THEN 1 ELSE 0 END), least(max(CASE WHEN {HEAD} THEN 1 ELSE 0 END), max(CASE WHEN {NEW} THEN 1 ELSE 0 END)) FROM {{:uses}} u JOIN homeless USING (file) WHERE {BASE} OR {HEAD} GROUP BY file
  UNION ALL SELECT rule, "from", "to", symbol, count(DISTINCT file) FILTER (side = 'base'), count(DISTINCT file) FILTER (side = 'head'), count(DISTINCT file) FILTER (side = 'head' AND new) FROM ({_copies('base', L_BASE)} UNION ALL {_copies('head', L_HEAD)}) GROUP BY ALL),
named AS (SELECT e.rule, e."from", e."to", e.symbol, x.expires, x."from" AS xf, x."to" AS xt, row_number() OVER () AS n FROM keys e JOIN (SELECT * FROM __EXC__) x ON e.rule = x.rule AND CASE WHEN x.rule = 'unowned' THEN regexp_matches(e."from", x.from_regex) WHEN x."to" IS NULL THEN e."from" = x."from" ELSE e."from" = x."from" AND e."to" = x."to" END),
fresh AS (SELECT * FROM keys k WHERE head_sites > base_sites AND (rule NOT IN ('unowned', 'duplication') OR added_sites > 0) AND NOT EXISTS (SELECT 1 FROM named n WHERE n.rule = k.rule AND n."from" = k."from" AND n."to" = k."to" AND n.symbol = k.symbol AND (expires IS NULL OR expires >= DATE '{TODAY}'))),
found AS (SELECT rule, "from", "to", symbol, base_sites::BIGINT AS base_sites, head_sites::BIGINT AS head_sites, added_sites::BIGINT AS added_sites, true AS from_change FROM fresh
  UNION ALL SELECT 'exception', n.xf, coalesce(n.xt, ''), n.rule, 0::BIGINT, 0::BIGINT, 0::BIGINT, coalesce(bool_or(f.rule IS NOT NULL), false) FROM named n JOIN keys k ON k.rule = n.rule AND k."from" = n."from" AND k."to" = n."to" AND k.symbol = n.symbol AND k.head_sites > 0
    LEFT JOIN fresh f ON f.rule = n.rule AND f."from" = n."from" AND f."to" = n."to" AND f.symbol = n.symbol WHERE n.expires < DATE '{TODAY}' GROUP BY n.rule, n.xf, n.xt)"""


def _keys() -> str:
    return KEYS.replace("__EXC__", EXC)


@query("assess_change", _keys() + " SELECT * FROM found")
def assess_change(f):
    return J.assess(error_keys(f), numbered(f), allowed(f), TODAY)


def items(f: Facts):
    """Unknown items of both trees."""
    u = masked(f.uses, BASE, HEAD, NEW).where("qty > 30")
    cause = F.when((F.col("flag") == "R") & (F.col("status") == "O"), "tool").otherwise("import")
    return u.select("file", "line", F.when(F.col("public"), F.col("target")).alias("specifier"), cause.alias("cause"), "base", "head")


ITEMS = f"SELECT file, line, CASE WHEN public THEN target END AS specifier, CASE WHEN flag = 'R' AND status = 'O' THEN 'tool' ELSE 'import' END AS cause, {BASE} AS base, {HEAD} AS head FROM {{:uses}} u WHERE qty > 30 AND ({BASE} OR {HEAD})"
REASONS = f"""WITH i AS (SELECT *, CASE WHEN specifier IS NOT NULL THEN regexp_replace(file, '/[^/]*$', '') ELSE file END AS place, coalesce(specifier, '') AS spec FROM ({ITEMS})),
m AS (SELECT place, spec, cause FROM i GROUP BY ALL HAVING count(*) FILTER (head) > count(*) FILTER (base)), c AS (SELECT DISTINCT file, true AS changed FROM {{:added}} a)
SELECT DISTINCT i.file, i.line, i.cause, CASE WHEN i.cause = 'tool' THEN 'tool' WHEN head AND changed THEN 'changed' ELSE 'more' END AS why, false AS on_base FROM i LEFT JOIN m ON m.place = i.place AND m.spec = i.spec AND m.cause = i.cause LEFT JOIN c ON c.file = i.file
WHERE i.cause = 'tool' OR (head AND (coalesce(changed, false) OR m.place IS NOT NULL))"""


@query("unknown_reasons", REASONS)
def unknown_reasons(f):
    return J.reasons(items(f), f.uses.where(NEW).select("file"))


@query("assess_status", f"""{_keys()}, why AS ({REASONS}), n AS (SELECT (SELECT count(*) FROM found WHERE rule <> 'exception') AS errors, (SELECT count(*) FROM found WHERE rule = 'exception') AS expired, (SELECT count(*) FROM why) AS unknown)
SELECT errors::BIGINT AS errors, expired::BIGINT AS expired, unknown::BIGINT AS unknown, CASE WHEN errors + expired > 0 THEN 'fail' WHEN unknown > 0 THEN 'unknown' ELSE 'pass' END AS status, errors + expired + unknown > 0 AS blocks FROM n""")
def assess_status(f):
    return J.status(assess_change(f), unknown_reasons(f), "required")


@query("change_verdict", ADDED + f""", v AS (SELECT (SELECT count(*) FROM change e WHERE NOT {HOLDS}) AS errors, (SELECT count(*) FROM ({EXPIRED})) AS expired, (SELECT count(*) FROM {{:head}} q WHERE qty > 43) AS unknown)
SELECT errors::BIGINT AS errors, expired::BIGINT AS expired, unknown::BIGINT AS unknown, CASE WHEN errors + expired > 0 THEN 'fail' WHEN unknown > 0 THEN 'unknown' ELSE 'pass' END AS status FROM v""")
def change_verdict(f):
    n = J.assess(keys(f), numbered(f), allowed(f), TODAY).agg(F.count_if(F.col("rule") != "exception").alias("errors"), F.count_if(F.col("rule") == "exception").alias("expired"))
    row = n.crossJoin(f.head.agg(F.count_if(F.col("qty") > 43).alias("unknown")))  # one row each
    return row.withColumn("status", F.when(F.col("errors") + F.col("expired") > 0, "fail").when(F.col("unknown") > 0, "unknown").otherwise("pass"))
