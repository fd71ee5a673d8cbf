"""Policy files with what must be found in them."""

from tessera.operators import policy as P
from tessera.sources import policyfile as D
from tessera.sources.document import values
from tessera.sources.scratch import cut

SMALL = "version: 3\nowners: [o]\nmodules:\n  core:\n    paths: [src/core/**]\n"
FULL = """version: 3   # the format
owners: [one, two]
gate: required
layers: [domain, edge]
modules:
  core: {paths: [src/core/**, lib/**], public: [src/core/api], subdomain: Core-less, layer: domain}
  edge:
    paths:
    - src/edge/**
    volatility: medium
    subdomain: generic
    layer: edge
    depends_on: [core]
builtin: {graph: deny, min_balance: 8}
rules:
  - id: no-edge
    deny: {from: [core, lib/x/**], to: edge}
    why: "inward: only"
    instead: turn it round
  - id: sql
    only: {use: database/sql, in: [core]}
    why: kept in one place
  - id: talk
    note: ask first
    why: it is new
exceptions:
  - {rule: graph, from: edge, to: core, why: moving, expires: 2027-01-31}
  - {rule: graph, from: edge, to: core, why: again}
  - rule: unowned
    from: scripts/**
    why: later
  - {rule: sql, from: edge, why: tool}
generated: ["**/*.pb.go"]
languages: {go: {enabled: true, modules: {include: [a, b]}}, python: {enabled: auto}}
analyzers: {roslyn: {timeout: 1m30s}}
coverage: {enabled: true, sources: [{path: c.out, format: lcov, max_bytes: 10}]}
""".replace("Core-less", "core")
RULE = "rules:\n  - id: r\n    why: w\n"
EXC = "exceptions:\n  - rule: graph\n    from: core\n    why: w\n"
WRONG = [
    (SMALL.replace("version: 3\n", ""), [("version", "missing")]), (SMALL.replace("3", "2", 1), [("version", "the older format")]), (SMALL.replace("3", "4", 1), [("version", "not read by this engine")]),
    (SMALL.replace("version: 3", "version: '3'"), [("version", "must be int"), ("version", "not read by this engine")]),
    (SMALL.replace("owners: [o]\n", ""), [("owners", "required")]), (SMALL.replace("[o]", "[]"), [("owners", "required")]), ("version: 3\nowners: [o]\n", [("modules", "required")]),
    (SMALL.replace("    paths: [src/core/**]", "    layer: x"), [("modules.core.paths", "required")]), (SMALL + "    public: []\n", [("modules.core.public", "empty")]),
    (SMALL + "    volatility: huge\n", [("modules.core.volatility", "is not one of low, medium, high")]), (SMALL + "    subdomain: best\n", [("modules.core.subdomain", "is not one of core, supporting, generic")]),
    (SMALL + "  core:\n    paths: [b]\n", [("modules.core", "given twice")]), (SMALL + "gate: maybe\n", [("gate", "is not one of advisory, required")]), (SMALL + "gate:\n", [("gate", "empty")]),
    (SMALL + "layers: [a, b, a]\n", [("layers", "a is listed twice")]), (SMALL + "colour: red\n", [("colour", "unknown key")]), (SMALL + "colour: {deep: {er: 1}}\n", [("colour", "unknown key")]),
    (SMALL + "builtin: {graph: loud}\n", [("builtin.graph", "is not one of deny, ask, off")]), (SMALL + "builtin: {min_balance: 11}\n", [("builtin.min_balance", "is outside 1 to 10")]), (SMALL + "builtin: {min_balance: 0}\n", [("builtin.min_balance", "is outside 1 to 10")]),
    (SMALL + RULE, [("rules[0]", "needs one of deny, only or note")]), (SMALL + RULE.replace("id: r", "note: n"), [("rules[0].id", "required")]),
    (SMALL + RULE + "    note: n\n    only: {use: x, in: core}\n", [("rules[0]", "has more than one of deny, only and note")]), (SMALL + "rules: [{id: r, note: n}]\n", [("rules[0].why", "required")]),
    (SMALL + RULE + "    deny: {from: core, to: []}\n    instead: i\n", [("rules[0].deny.to", "empty")]), (SMALL + RULE + "    deny: {from: core, to: x}\n", [("rules[0].instead", "required with deny")]),
    (SMALL + RULE + "    deny: {from: core}\n    instead: i\n", [("rules[0].deny.to", "required")]), (SMALL + RULE + "    only: {in: core}\n", [("rules[0].only.use", "required")]),
    (SMALL + EXC, [("exceptions[0].to", "required")]), (SMALL + EXC.replace("graph", "unowned") + "    to: core\n", [("exceptions[0].to", "unowned has no target")]),
    (SMALL + RULE + "    only: {use: x, in: core}\n" + EXC.replace("graph", "r") + "    to: core\n", [("exceptions[0].to", "an only rule names its library")]),
    (SMALL + EXC + "    to: core\n    expires: 2027-02-30\n", [("exceptions[0].expires", "is not a date")]), (SMALL + EXC + "    to: core\n    expires: 31.1.2027\n", [("exceptions[0].expires", "is not a date")]),
    (SMALL + EXC.replace("    why: w\n", "") + "    to: core\n", [("exceptions[0].why", "required")]), (SMALL + "languages: {go: {enabled: perhaps}}\n", [("languages.go.enabled", "is not one of true, false, auto")]),
    (SMALL + "analyzers: {roslyn: {timeout: soon}}\n", [("analyzers.roslyn.timeout", "is not a duration")]), (SMALL + "coverage: {enabled: true}\n", [("coverage.sources", "required when coverage is enabled")]),
    (SMALL + "coverage: {sources: [{format: lcov}]}\n", [("coverage.sources[0].path", "required")]), (SMALL + "tests: all\n", [("tests", "must be list")]), (SMALL + "x: [1\n", [("", "cannot be read: a bracket is left open")]),
]


def test_problems(spark):
    cases = [(SMALL, []), (FULL, []), *WRONG]
    df = spark.createDataFrame([(f"{k}", t) for k, (t, _) in enumerate(cases)], "doc string, text string").repartition(4)
    v = cut(values(df), "values")
    got = {}
    for r in D.problems(v).collect():
        got.setdefault(int(r.policy), []).append((r.path, r.problem))
    for k, (text, want) in enumerate(cases):
        assert sorted(got.get(k, [])) == sorted(want), text
    wrong = D.problems(v)
    assert {r.policy for r in D.rows(v, wrong).select("policy").distinct().collect()} == {"0", "1"}


def test_rows(spark):
    v = cut(values(spark.createDataFrame([("p", FULL), ("q", SMALL)], "doc string, text string")), "values")
    rows = D.rows(v, D.problems(v))
    got = {tuple(r)[1:] for r in rows.where("policy = 'p'").collect()}
    for want in [
        ("module", "core", "paths", 1, "lib/**"), ("module", "core", "public", 0, "src/core/api"), ("module", "core", "volatility", 0, "high"), ("module", "edge", "public", 0, "src/edge/**"),
        ("module", "edge", "volatility", 0, "medium"), ("module", "edge", "depends_on", 0, "core"), ("rule", "no-edge", "form", 0, "deny"), ("rule", "no-edge", "deny.from", 1, "lib/x/**"),
        ("rule", "no-edge", "deny.to", 0, "edge"), ("rule", "sql", "only.use", 0, "database/sql"), ("rule", "talk", "form", 0, "note"), ("exception", "graph edge > core", "expires", 0, "2027-01-31"),
        ("exception", "graph edge > core #2", "why", 0, "again"), ("exception", "unowned scripts/**", "from", 0, "scripts/**"), ("builtin", "graph", "mode", 0, "deny"), ("builtin", "cycle", "mode", 0, "deny"),
        ("builtin", "coupling", "min_balance", 0, "8"), ("top", "", "layers", 1, "edge"), ("top", "", "gate", 0, "required"), ("top", "", "generated", 0, "**/*.pb.go"),
        ("setting", "", "languages.go.modules.include[1]", 0, "b"), ("setting", "", "coverage.sources[0].max_bytes", 0, "10"),
    ]:
        assert want in got or (want[0] == "setting" and any(w[:3] == want[:3] and w[4] == want[4] for w in got)), want
    small = {tuple(r)[1:] for r in rows.where("policy = 'q'").collect()}
    assert small == {("top", "", "owners", 0, "o"), ("top", "", "gate", 0, "advisory"), ("module", "core", "paths", 0, "src/core/**"), ("module", "core", "public", 0, "src/core/**"), ("module", "core", "volatility", 0, "high"), ("builtin", "coupling", "min_balance", 0, "7"), *(("builtin", r, "mode", 0, m) for r, m in {"graph": "ask", "coupling": "deny", "duplication": "ask", "cycle": "deny", "layers": "deny", "unowned": "deny"}.items())}
    assert P.check(rows).count() == 0  # what the policy operators take
