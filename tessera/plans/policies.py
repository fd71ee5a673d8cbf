"""Policy comparison, checks and owners.  The cases are policies written by hand with what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import owners
from ..operators import policy as P
from ..sources.scratch import parts
from .registry import Facts, query

BASE = {
    ("module", "a", "paths"): ["src/a/**"], ("module", "a", "public"): ["src/a/api/**"], ("module", "a", "volatility"): ["medium"], ("module", "a", "layer"): ["core"], ("module", "a", "depends_on"): ["b"],
    ("module", "b", "paths"): ["src/b/**"], ("module", "b", "public"): ["src/b/**"], ("module", "b", "volatility"): ["low"],
    ("rule", "r", "form"): ["deny"], ("rule", "r", "deny.from"): ["a"], ("rule", "r", "deny.to"): ["src/b/**"], ("rule", "r", "why"): ["it is so"],
    ("rule", "o", "form"): ["only"], ("rule", "o", "only.use"): ["lib"], ("rule", "o", "only.in"): ["a"], ("rule", "n", "form"): ["note"],
    ("exception", "graph a > b", "rule"): ["graph"], ("exception", "graph a > b", "from"): ["a"], ("exception", "graph a > b", "to"): ["b"], ("exception", "graph a > b", "expires"): ["2026-01-01"],
    ("builtin", "graph", "mode"): ["ask"], ("builtin", "coupling", "min_balance"): ["7"], ("top", "", "gate"): ["advisory"], ("top", "", "layers"): ["core", "edge"], ("top", "", "owners"): ["x", "y"],
    ("top", "", "tests"): ["**/*_test.go"], ("setting", "", "coverage.path"): ["c"], ("setting", "", "scan.depth"): ["3"],
}


def but(changes: dict) -> dict:
    """BASE with other values; a value of None takes a field away, a field of None all of a name."""
    out = {k: v for k, v in BASE.items() if (k[0], k[1], None) not in changes}
    out |= {k: v for k, v in changes.items() if k[2]}
    return {k: v for k, v in out.items() if v is not None}


def rows(p: dict) -> list[tuple]:
    return [(*k, i, v) for k, values in p.items() for i, v in enumerate(values)]


L, T, N = P.LOOSENS, P.TIGHTENS, P.NEITHER
CASES = [(BASE, but(c), want) for c, want in [
    ({}, []),
    ({("module", "b", None): None, ("rule", "r", "deny.to"): ["src/b/**"]}, [("module", "b", None, L, "b", None)]),
    ({("module", "c", "paths"): ["c/**"], ("module", "c", "public"): ["c/**"]}, [("module", "c", None, L, None, "c")]),
    ({("module", "a", "paths"): ["src/a/**", "src/a/x/**"]}, [("module", "a", "paths", L, None, "src/a/x/**")]),
    ({("module", "a", "public"): ["src/a/**"]}, [("module", "a", "public", L, None, "src/a/**")]),
    ({("module", "a", "public"): ["src/a/api/one/**"]}, [("module", "a", "public", T, "src/a/api/**", None)]),
    ({("module", "b", "paths"): ["src/b2/**"], ("module", "b", "public"): ["src/b2/**"]}, [("module", "b", "paths", L, None, "src/b2/**"), ("module", "b", "paths", L, "src/b/**", None)]),
    ({("module", "a", "volatility"): ["high"]}, [("module", "a", "volatility", T, "medium", "high")]),
    ({("module", "a", "volatility"): ["low"]}, [("module", "a", "volatility", L, "medium", "low")]),
    ({("module", "a", "layer"): None, ("module", "b", "layer"): ["edge"]}, [("module", "a", "layer", L, "core", None), ("module", "b", "layer", T, None, "edge")]),
    ({("module", "a", "depends_on"): None, ("module", "b", "depends_on"): ["a"]}, [("module", "a", "depends_on", T, "b", None), ("module", "b", "depends_on", L, None, "a")]),
    ({("rule", "r", None): None, ("rule", "q", "form"): ["note"]}, [("rule", "r", None, L, "r", None), ("rule", "q", None, T, None, "q")]),
    ({("rule", "r", "deny.to"): ["src/b/x/**"]}, [("rule", "r", "deny.to", L, "src/b/**", None)]),
    ({("rule", "r", "deny.from"): ["a", "b"], ("rule", "r", "why"): ["no"]}, [("rule", "r", "deny.from", T, None, "b"), ("rule", "r", "why", N, "it is so", "no")]),
    ({("rule", "r", "form"): ["note"], ("rule", "r", "deny.from"): None, ("rule", "n", "form"): ["deny"], ("rule", "n", "deny.to"): ["a"]}, [("rule", "r", "form", L, "deny", "note"), ("rule", "n", "form", T, "note", "deny")]),
    ({("rule", "o", "only.use"): ["lib2"], ("rule", "o", "only.in"): ["a", "b"]}, [("rule", "o", "only.use", L, "lib", "lib2"), ("rule", "o", "only.in", L, None, "b")]),
    ({("exception", "graph a > b", "expires"): ["2026-02-01"]}, [("exception", "graph a > b", "expires", L, "2026-01-01", "2026-02-01")]),
    ({("exception", "graph a > b", "expires"): None}, [("exception", "graph a > b", "expires", L, "2026-01-01", None)]),
    ({("exception", "graph a > b", None): None, ("exception", "graph b > a", "rule"): ["graph"]}, [("exception", "graph a > b", None, T, "graph a > b", None), ("exception", "graph b > a", None, L, None, "graph b > a")]),
    ({("builtin", "graph", "mode"): ["deny"], ("builtin", "coupling", "min_balance"): ["10"]}, [("builtin", "graph", "mode", T, "ask", "deny"), ("builtin", "coupling", "min_balance", T, "7", "10")]),
    ({("top", "", "gate"): ["required"], ("top", "", "owners"): ["y", "x"], ("top", "", "layers"): ["edge", "core"]}, [("top", "", "gate", T, "advisory", "required"), ("top", "", "layers", L, "core, edge", "edge, core")]),
    ({("top", "", "tests"): ["**"], ("setting", "", "coverage.path"): ["d"], ("setting", "", "scan.depth"): None}, [("top", "", "tests", L, None, "**"), ("setting", "", "coverage.path", N, "c", "d"), ("setting", "", "scan.depth", L, "3", None)]),
]]
WRONG = [(but(c), want) for c, want in [
    ({}, []),
    ({("module", "a", "depends_on"): ["bb", "zzzzz"]}, [("module", "a", "depends_on", "bb", "not a module", "b"), ("module", "a", "depends_on", "zzzzz", "not a module", None)]),
    ({("module", "a", "layer"): ["cor"]}, [("module", "a", "layer", "cor", "not a layer", None)]),
    ({("rule", "r", "deny.from"): ["src/x/**", "c"]}, [("rule", "r", "deny.from", "c", "not a module", "a")]),
    ({("rule", "graph", "form"): ["note"], ("rule", "n", "form"): ["note", "note"]}, [("rule", "graph", "id", "graph", "built-in id", None), ("rule", "n", "id", "n", "id of two rules", None)]),
    ({("exception", "graph a > b", "rule"): ["grap"], ("exception", "graph a > b", "to"): ["nowhere"]}, [("exception", "graph a > b", "rule", "grap", "not a rule", "graph"), ("exception", "graph a > b", "to", "nowhere", "not a module", None)]),
    ({("exception", "u", "rule"): ["unowned"], ("exception", "u", "from"): ["src/old/**"], ("exception", "o", "rule"): ["o"], ("exception", "o", "from"): ["a"], ("exception", "o", "to"): ["b"]}, [("exception", "o", "to", "b", "an only rule names its library", None)]),
]]


def _dealt(f: Facts, policies: list[dict]):
    """Every customer has the policy of one case.  Customers are dealt before each becomes some thirty rows."""
    known = f.spark.createDataFrame([(i, *r) for i, p in enumerate(policies) for r in rows(p)], "case int, section string, name string, field string, pos int, value string")
    asked = f.customer.select(F.col("c_custkey").alias("policy")).repartition(parts(f.spark), "policy")
    return asked.withColumn("case", (F.col("policy") % len(policies)).cast("int")).join(known, "case").drop("case")


def _wanted(cases: list, columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'"

    values = ", ".join(f"({i}, {', '.join(map(lit, w))})" for i, want in enumerate(cases) for w in want)
    return f"SELECT c_custkey AS policy, {columns} FROM customer JOIN (VALUES {values}) w(i, {columns}) ON i = c_custkey % {len(cases)}"


def changes(f: Facts):
    return P.compare(_dealt(f, [b for b, _, _ in CASES]), _dealt(f, [a for _, a, _ in CASES]))


COLUMNS = "section, name, field, direction, \"before\", \"after\""


@query("policy_changes", _wanted([w for _, _, w in CASES], COLUMNS))
def policy_changes(f):
    return changes(f)


@query("policy_direction", f"WITH w AS ({_wanted([w for _, _, w in CASES], COLUMNS)}) SELECT c_custkey AS policy, CASE WHEN bool_or(direction = 'loosens') THEN 'loosens' WHEN bool_or(direction = 'tightens') THEN 'tightens' ELSE 'neither' END AS direction FROM customer LEFT JOIN w ON policy = c_custkey GROUP BY 1")
def policy_direction(f):
    return P.direction(f.customer.select(F.col("c_custkey").alias("policy")), changes(f))


@query("policy_check", _wanted([w for _, w in WRONG], "section, name, field, value, problem, suggestion"))
def policy_check(f):
    return P.check(_dealt(f, [p for p, _ in WRONG]))


CODEOWNERS = """# whole tree
*                      @everyone
src/nation_1*          @team-one @other
/src/nation_2/         @two

api/                   @nobody-here
g4.go                  @four
/src/nation_1[0-3]/impl  @core
src/nation_3/impl/g[0-1].go  @three
*/nation_4             @deep
src/nation_9/api
"""
OWN = """CASE WHEN regexp_matches(target, '^[^/]+/nation_4/') THEN '@deep' WHEN regexp_matches(target, '^src/nation_3/impl/g[01][.]go$') THEN '@three' WHEN regexp_matches(target, '^src/nation_1[0-3]/impl/') THEN '@core'
WHEN regexp_matches(target, '/g4[.]go$') THEN '@four' WHEN target LIKE 'src/nation!_2/%' ESCAPE '!' THEN '@two' WHEN target LIKE 'src/nation!_1%' ESCAPE '!' THEN '@team-one' ELSE '@everyone' END"""


@query("last_match_owner", f"WITH m AS (SELECT DISTINCT to_module AS module, target FROM {{:uses}} u), n AS (SELECT module, {OWN} AS owner, count(*) AS files FROM m GROUP BY ALL) SELECT module, arg_min(owner, (100000 - files) || owner) AS owner, max(files)::BIGINT AS files FROM n GROUP BY module")
def last_match_owner(f):
    m = f.uses.select(F.col("to_module").alias("module"), F.col("target").alias("file")).distinct()
    return owners.by_module(owners.owned(m, owners.parse(CODEOWNERS)))
