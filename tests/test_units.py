"""Deploy units and requests."""

from tessera.operators import request
from tessera.sources import units


def test_units(spark):
    texts = {
        "cmd/app/main.go": "// x\npackage main\n", "cmd/tool/deep/main.go": "package main", "own/main.go": "package main\n", "lib/a.go": "package mainly\n", "main.go": "package main",
        "package.json": '{"name":"top","bin":{"a":"b"},"workspaces":{"packages":["packages/*","./web"]}}', "packages/a/package.json": '{"name":"@s/a"}', "packages/b/package.json": "{}", "packages/b/c/package.json": '{"name":"no"}', "web/package.json": '{"name":""}', "other/package.json": '{"name":"x"}', "packages/e/package.json": "{",
        "py/pyproject.toml": "[tool.x]\nname = 'no'\n[project]\nversion = '1'\nname = \"pie\"\n", "py2/pyproject.toml": "[project]\nversion='1'\n[tool]\nname='no'\n", "vendor/v/pyproject.toml": "[project]\nname='v'",
        "Dockerfile": None, "py/Dockerfile": "FROM x", "img/Dockerfile.prod": "", "img2/Dockerfile2": "",
        "k/a.yaml": "kind: Service\nmetadata:\n  name: s\n---\napiVersion: 1\nkind: Deployment\nmetadata:\n  labels:\n    name: inner\n  name: dep\nspec:\n  name: no\n", "k/b.yml": "kind: StatefulSet\n", "k2/b.YML": "kind: StatefulSet\n", "k3/c.yaml": "kind: Job\nmetadata:\n  name: j", "n.go": None,
    }
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    owners = spark.createDataFrame([("cmd/app", None, None), ("own", "mod", True), ("cmd/tool/deep", "tool", False), ("py", "p", False), ("py2", "p", False)], "dir string, module string, is_root boolean")
    found = units.units(files, owners, "repo")
    assert sorted(tuple(r) for r in found.collect()) == [
        (".", "top", "workspace"), ("cmd/app", "app", "go_main"), ("img", "img", "dockerfile"), ("k", "dep", "k8s"), ("k2", "k2", "k8s"), ("own", "mod", "go_main"),
        ("packages/a", "@s/a", "workspace"), ("packages/b", "b", "workspace"), ("py", "pie", "pyproject"), ("py2", "py2", "pyproject"), ("web", "web", "workspace"),
    ]
    assert sorted(tuple(r) for r in units.by_module(found, owners).collect()) == [("mod", "mod", "go_main", "own"), ("p", "pie", "pyproject", "py")]
    assert units.units(files.limit(0), owners).count() == 0


def test_requests(spark):
    checks = spark.createDataFrame([(1, "fail", "2026-01-01", None), (2, "fail", "2026-01-01", "2027-01-10"), (3, "fail", "2026-01-01", "2027-01-11"), (4, "fail", "2026-03-01", "2026-03-01"), (5, "unknown", "2026-01-01", None), (6, "pass", "2026-01-01", None), (7, "fail", "2026-01-01", None)], "check int, status string, date string, expires string").selectExpr("check", "status", "to_date(date) AS date", "to_date(expires) AS expires")
    rows = [(c, "command", "graph", "a", "b", f, 1) for c in (1, 2, 3, 4, 5) for f in ("y", "x")] + [(7, "fix", "graph", "a", "b", "x", 1)]
    errors = spark.createDataFrame(rows, "check int, next string, rule string, from string, to string, file string, line int")
    got = {r["check"]: (r["outcome"], [e["file"] for e in r["errors"] or []]) for r in request.requests(checks, errors, "2026-01-10").collect()}
    assert got == {1: ("request", ["x", "y"]), 2: ("request", ["x", "y"]), 3: ("bad date", []), 4: ("bad date", []), 5: ("no verdict", []), 6: ("nothing to ask", []), 7: ("nothing to ask", [])}
