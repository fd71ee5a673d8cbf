from tessera.sources import placing as P

FACT = "report string, file string, covered long, total long, unit string"


def test_paths(spark):
    files = spark.createDataFrame([(f,) for f in ["a/x.go", "svc/b/y.go", "svc/b/in/z.go", "top.py", "pkg/m.ts"]], "file string")
    modules = spark.createDataFrame([("ex.org/app", ""), ("ex.org/app/b", "svc/b")], "path string, dir string")
    cases = {
        "ex.org/app/a/x.go": "a/x.go", "ex.org/app/b/y.go": "svc/b/y.go", "ex.org/app/b/in/z.go": "svc/b/in/z.go", "ex.org/apples/a/x.go": None, "./a/x.go": "a/x.go", " a\\x.go ": "a/x.go",
        "/repo/top.py": "top.py", "/repo/../repo/a/x.go": "a/x.go", "/else/top.py": None, "/repository/top.py": None, "C:\\repo\\top.py": None, "../top.py": None, "": None, "gone.py": None, "web/pkg/m.ts": "pkg/m.ts",
    }
    facts = spark.createDataFrame([("r", f, 1, 2, "lines") for f in cases], FACT)
    got = P.placed(facts, files, modules, "/repo", "web")
    assert {r.file: r.path for r in got.collect()} == cases
    assert [tuple(r) for r in P.unresolved(got).collect()] == [("r", len(cases), 7)]


def test_reconciliation_and_roll_up(spark):
    rows = [("r1", "a", 3, 10, "lines"), ("r2", "a", 7, 10, "lines"), ("r3", "b", 1, 4, "lines"), ("r4", "b", 1, 5, "lines"), ("r1", "t", 9, 9, "lines"), ("r5", "a", 2, 3, "statements"), ("r1", "none", 1, 1, "lines")]
    files = spark.createDataFrame([("a", "m", "production"), ("b", "m", "production"), ("t", "m", "test"), ("c", "n", "production"), ("d", None, "production")], "file string, module string, class string")
    facts = P.placed(spark.createDataFrame(rows, FACT), files, spark.createDataFrame([], "path string, dir string"))
    got = {tuple(r) for r in P.rolled_up(files, P.reconciled(facts)).collect()}
    assert got == {("m", "lines", 2, 2, 1, 7, 10, 0.7), ("m", "statements", 2, 1, 0, 2, 3, 0.666667), ("n", None, 1, 0, 0, None, None, None)}
