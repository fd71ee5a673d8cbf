"""Policy comparison and checks, case by case."""

from tessera.operators import policy as P
from tessera.plans.policies import BASE, CASES, WRONG, rows

SCHEMA = "policy int, section string, name string, field string, pos int, value string"


def test_compare(spark):
    before = spark.createDataFrame([(i, *r) for i, (b, _, _) in enumerate(CASES) for r in rows(b)], SCHEMA)
    after = spark.createDataFrame([(i, *r) for i, (_, a, _) in enumerate(CASES) for r in rows(a)], SCHEMA)
    got = P.compare(before, after)
    found = {}
    for r in got.collect():
        found.setdefault(r["policy"], set()).add((r["section"], r["name"], r["field"], r["direction"], r["before"], r["after"]))
    for i, (b, a, want) in enumerate(CASES):
        assert found.get(i, set()) == set(want), (i, b, a)
    ways = {r["policy"]: r["direction"] for r in P.direction(before, got).collect()}
    for i, (_, _, want) in enumerate(CASES):
        said = {w[3] for w in want}
        assert ways[i] == ("loosens" if "loosens" in said else "tightens" if "tightens" in said else "neither")


def test_check(spark):
    p = spark.createDataFrame([(i, *r) for i, (x, _) in enumerate(WRONG) for r in rows(x)], SCHEMA)
    found = {}
    for r in P.check(p).collect():
        found.setdefault(r["policy"], set()).add((r["section"], r["name"], r["field"], r["value"], r["problem"], r["suggestion"]))
    for i, (x, want) in enumerate(WRONG):
        assert found.get(i, set()) == set(want), (i, x)


def test_no_policies(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.compare(empty, empty).count() == 0 and P.check(empty).count() == 0
    some = spark.createDataFrame([(0, *r) for r in rows(BASE)], SCHEMA)
    assert P.direction(some, P.compare(some, some)).collect()[0]["direction"] == "neither"


def test_overlap(spark):
    from pyspark.sql import functions as F

    cases = [("a/**", "a/b/*.go", True), ("a/*.go", "b/*.go", False), ("**", "x", True), ("a{b,c}", "ad", True), ("ab", "ac", False)]
    d = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert d.where(P.may_overlap(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_owners(spark):
    from tessera.operators import owners

    text = "*.go @go\n# c\n/docs/ @docs\nlib @lib\na/b* @ab\n/x?[^q] @x\nbad[ @bad\nnone\n"
    want = {"m.go": "@go", "d/m.go": "@go", "docs/a/b.go": "@docs", "y/docs/a.txt": None, "lib": "@lib", "z/lib": "@lib", "lib/a": None, "a/bc/d/e.go": "@ab", "q/a/b": None, "xyz/t": "@x", "xyq": None, "x/z": None, "none": None}
    d = spark.createDataFrame([(k,) for k in want], "file string")
    got = {r["file"]: r["owner"] for r in owners.owned(d, owners.parse(text)).collect()}
    assert {k: got.get(k) for k in want} == want
    assert owners.owned(d, []).count() == 0


def test_a_selector_like_a_path_is_a_name_where_a_module_has_it(spark):
    rule = [("rule", "r", "form", 0, "deny"), ("rule", "r", "deny.from", 0, "src/x/**")]
    module = [("module", "src/x/y", "paths", 0, "src/x/y/**")]
    wider = [("rule", "r", "deny.from", 1, "src/x/y")]
    before = spark.createDataFrame([(0, *r) for r in rule] + [(1, *r) for r in rule + module], SCHEMA)
    after = spark.createDataFrame([(0, *r) for r in rule + wider] + [(1, *r) for r in rule + module + wider], SCHEMA)
    assert [tuple(r) for r in P.compare(before, after).collect()] == [(1, "rule", "r", "deny.from", "tightens", None, "src/x/y")]


def test_rows_of_policies_are_dealt_once_and_by_number(spark):
    plan = P.compare(*[spark.range(10).selectExpr("id AS policy", "'rule' AS section", "'r' AS name", "'form' AS field", "0 AS pos", "'deny' AS value") for _ in range(2)])._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union")]
    assert top.count("Exchange hashpartitioning(policy") == 1 and "REPARTITION_BY_NUM" in top and "Join" not in top
