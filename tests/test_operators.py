import random

from pyspark.sql import functions as F

from tessera.operators import change, classify, graph, rules, uses
from tessera.sources import text


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def test_graphs_against_plain(spark):
    rng = random.Random(1)
    for n, m in ((8, 9), (12, 20), (5, 0)):
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        df = spark.createDataFrame(sorted(e), "a int, b int")
        want = closure(e)
        assert {tuple(r) for r in graph.reach(df).collect()} == want
        comp = {r.node: r.component for r in graph.strong_components(df).collect()}
        for a in range(n):
            same = {b for b in range(n) if a != b and (a, b) in want and (b, a) in want}
            assert comp.get(a) == (min(same | {a}) if same else None)


def test_slice_of_three_modules(spark):
    u = spark.createDataFrame([("a/1.go", 1, "a", "b", True), ("a/1.go", 2, "a", "c", False), ("b/1.go", 1, "b", "c", False), ("b/1.go", 1, "b", "c", False)], "file string, line long, from_module string, to_module string, public boolean")
    may = spark.createDataFrame([("a", "b"), ("b", "c")], "module string, target string")
    mods = spark.createDataFrame([("a", "low", None), ("b", "low", None), ("c", "high", None)], "module string, volatility string, subdomain string")
    found = rules.errors_by_key(rules.graph(u, may)).collect()
    assert [(r["from"], r["to"], r.sites) for r in found] == [("a", "c", 1)]
    bad = rules.errors_by_key(rules.coupling(u, mods)).orderBy("from").collect()
    assert [(r["from"], r["to"]) for r in bad] == [("a", "c"), ("b", "c")]
    assert rules.coupled(u, mods).where("to_module = 'c'").agg(F.min("balance")).first()[0] == 2
    assert rules.graph(u.limit(0), may).count() == 0


def test_exceptions(spark):
    e = spark.createDataFrame([("graph", "a", "b"), ("graph", "a", "c"), ("duplication", "x", "y")], "rule string, `from` string, `to` string")
    x = spark.createDataFrame([("graph", "a", "b", "1995-02-15", None), ("graph", "a", "c", "1995-02-14", None), ("duplication", "y", "x", None, None)], "rule string, `from` string, `to` string, expires string, from_regex string").withColumn("expires", F.to_date("expires"))
    got = {(r["from"], r["to"]): r.covered for r in change.covered(e, x, "1995-02-15").collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("x", "y"): True}
    gone = change.expired_errors(e, x, "1995-02-15").collect()
    assert [(r["from"], r["to"], r.errors) for r in gone] == [("a", "c", 1)]


def test_score_cells(spark):
    cells = {(r.strength, r.distance, r.vol): r for r in classify.score_table(spark).collect()}
    assert cells["intrusive", "cross_module", "high"].balance == 2 and cells["contract", "cross_module", "high"].balance == 9
    assert cells["functional", "same_module", "frozen"].balance == 10 and cells["unknown", "external", "low"].balance is None
    assert cells["intrusive", "cross_module", "high"].severity == "critical" and cells["intrusive", "cross_module", "frozen"].severity == ""


def test_module_of_takes_the_most_specific(spark):
    paths = uses.paths_table(spark, [("a", "src/**"), ("b", "src/x/**"), ("d", "src/x/**"), ("c", "lib/*.go")])
    files = spark.createDataFrame([("src/x/1.go",), ("src/2.go",), ("lib/3.go",), ("lib/s/4.go",)], "file string")
    assert {r.file: r.module for r in uses.module_of(files, paths).collect()} == {"src/x/1.go": "b", "src/2.go": "a", "lib/3.go": "c", "lib/s/4.go": None}
    assert [(r.module_a, r.module_b, r.files) for r in uses.ownership_ties(files, paths).collect()] == [("b", "d", 1)]


def test_text_facts(spark):
    diff = "+++ b/x\n@@ -1,3 +1,4 @@\n same\n+++ one\n-gone\n+two\n@@ -9,0 +20,2 @@\n+x\n+y"
    df = spark.createDataFrame([("d", diff)], "file string, text string")
    assert sorted(r.line for r in text.added_lines(df).collect()) == [2, 3, 20, 21]


def test_strength_precedence(spark):
    from pyspark.sql import functions as F

    from tessera.operators.classify import strength

    cases = [
        (True, False, "functional", None, "contract"), (True, False, "intrusive", None, "intrusive"), (True, False, "functional", "model", "model"), (True, True, "symmetric", None, "contract"),
        (False, True, "contract", None, "intrusive"), (False, False, "symmetric", "model", "symmetric"), (False, False, "unknown", None, "unknown"), (True, False, "intrusive", "model", "intrusive"),
    ]
    df = spark.createDataFrame(cases, "public boolean, internal boolean, hint string, data string, want string")
    assert all(r.got == r.want for r in df.select("want", strength(F.col("public"), F.col("internal"), F.col("hint"), F.col("data")).alias("got")).collect())


def test_calibration_scores(spark):
    from pyspark.sql import functions as F

    from tessera.operators import classify as C

    cases = [
        ("intrusive", "different_deploy_unit", "high", 10, 10, "reduce_strength"), ("functional", "different_owner", "medium", 7, 6, "reduce_strength"), ("contract", "cross_module", "low", 0, 2, ""),
        ("intrusive", "cross_module", "low", 7, 3, None), ("functional", "same_module", "high", 0, 0, ""), ("model", "external", "undeclared", 8, 1, None), ("unknown", "unknown", "unknown", 5, 5, None),
    ]
    df = spark.createDataFrame(cases, "s string, d string, v string, a int, m int, move string")
    k = (F.col("s"), F.col("d"), F.col("v"))
    for r in df.select("*", C.additive(*k).alias("ga"), C.multiplicative(*k).alias("gm"), C.cheapest_move(C.additive, *k).alias("gmove")).collect():
        assert (r.ga, r.gm) == (r.a, r.m), r
        assert r.move is None or r.gmove == r.move, r


def test_shapes_and_carry(spark):
    from pyspark.sql import functions as F

    from tessera.operators.rules import shape
    from tessera.sources.text import carried

    values = {'json:"id" xml:"x"': "tag", "snake_case_name": "word", "a.b:c@d-e": "word", "two words": "other", "slash/path": "other", "été": "word"}
    got = {r.v: r.s for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", shape(F.col("v")).alias("s")).collect()}
    assert got == values
    rows = [(i, i if i in (3, 900) else None) for i in range(2000)]
    got = {r.at: r.x for r in carried(spark.createDataFrame(rows, "at long, x long"), "at", "x", 64).collect()}
    assert got == {i: None if i < 3 else 3 if i < 900 else 900 for i in range(2000)}
