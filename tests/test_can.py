"""Questions to a policy of five modules about a small tree, with the answer that each must have."""

from pyspark.sql import functions as F

from tessera.functions.globs import glob_regex
from tessera.operators import can as C
from tessera.operators.uses import paths_table

GLOBS = [("a", "src/a/**"), ("b", "src/b/**"), ("c", "src/c/**"), ("d", "src/d/**"), ("top", "cmd/*.go")]
FILES = [
    ("src/a/x.go", "production"), ("src/a/x_test.go", "test"), ("src/b/api/y.go", "production"), ("src/b/in/z.go", "production"), ("src/c/p.py", "production"), ("src/c/q.go", "production"),
    ("src/d/legacy/o.go", "production"), ("src/d/w.go", "production"), ("src/d/n.go", "production"), ("cmd/m.go", "production"), ("gen/only_test.go", "test"), ("docs/r.md", "production"), ("a.go", "production"),
]
MODULES = [("a", "low", None, 2), ("b", "low", None, 1), ("c", "low", None, 0), ("d", None, "Core", None), ("top", "low", None, 2)]
DEPENDS = [("a", "b"), ("a", "d"), ("c", "a"), ("top", "a"), ("d", "b"), ("top", "b")]
RULES = [
    {"id": "no-legacy", "form": "deny", "from": ["a"], "to": ["src/d/legacy/**"], "why": "it goes away", "instead": "use d"},
    {"id": "w-alone", "form": "deny", "from": ["src/d/w.go"], "to": ["b"]},
    {"id": "sql", "form": "only", "use": "db/sql", "in": ["b", "src/c/q.go"], "why": "one place"},
    {"id": "net", "form": "only", "use": "@net", "in": ["b"]},
]
SETS = {"@net": [("go", "net/http", False), ("python", "requests", False), ("go", "net", True)]}


def ask(spark, pairs, covered=None, modes=None, rules=RULES):
    questions = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, from string, to string")
    public = spark.createDataFrame([("b", glob_regex("src/b/api/**")), ("d", glob_regex("src/d/n.go"))], "module string, regex string")
    out = C.can(
        questions, spark.createDataFrame(FILES, "file string, class string"), paths_table(spark, GLOBS), spark.createDataFrame(MODULES, "module string, volatility string, subdomain string, layer_pos int"),
        spark.createDataFrame(DEPENDS, "module string, target string"), public, C.rules_table(spark, rules, [m for m, *_ in MODULES], SETS), spark.createDataFrame([("ex.org/app", "")], "path string, dir string"),
        None if covered is None else spark.createDataFrame(covered, "rule string, from string, to string"), modes,
    )
    assert out.columns == C.ANSWER
    return [r.asDict() for r in out.orderBy("id").collect()]


CASES = {
    # by module names
    ("a", "b"): ("yes", None, None), ("b", "d"): ("no", "graph", "request"), ("b", "a"): ("no", "layers", "fix"), ("a", "a"): ("yes", None, None), ("a", "top"): ("no", "graph", "request"),
    # a module asked for whose paths a rule may mean
    ("a", "d"): ("unknown", "no-legacy", "ask for a file of a"), ("d", "b"): ("unknown", "w-alone", "ask for a file of d"),
    # files of the tree, public part and past it
    ("src/a/x.go", "src/b/api/y.go"): ("yes", None, None), ("src/a/x.go", "src/b/in/z.go"): ("yes", None, None), ("./src/a/../a/x.go", "src/d/legacy/o.go"): ("no", "no-legacy", "fix"),
    ("src/a/x_test.go", "src/d/legacy/o.go"): ("yes", None, None), ("src/d/w.go", "src/b/api/y.go"): ("no", "w-alone", "fix"), ("src/d/n.go", "src/b/api"): ("yes", None, None),
    # directories: their files agree or not; import paths of the tree
    ("src/d", "src/b/api"): ("unknown", None, "ask for a file of src/d"), ("src/a", "src/d/legacy"): ("no", "no-legacy", "fix"), ("src/a", "ex.org/app/src/d/legacy"): ("no", "no-legacy", "fix"), ("cmd", "src/b"): ("yes", None, None),
    # files not written yet, paths in no module
    ("src/a/new.go", "src/b/api/y.go"): ("yes", None, None), ("docs/r.md", "b"): ("unknown", None, "rules for docs/r.md"), ("a", "src/util"): ("unknown", None, "rules for src/util"), ("a", "./lib"): ("unknown", None, "rules for ./lib"), ("a", "docs.x"): ("unknown", None, "rules for docs.x"),
    # libraries
    ("b", "db/sql"): ("yes", None, None), ("a", "db/sql"): ("no", "sql", "fix"), ("a", "db/sql/driver"): ("unknown", "sql", "ask for a file of a"), ("src/a/x.go", "db/sql/driver"): ("no", "sql", "fix"), ("src/a/x.go", "db/sqlite"): ("yes", None, None),
    ("c", "db/sql"): ("unknown", "sql", "ask for a file of c"), ("src/c/q.go", "db/sql"): ("yes", None, None), ("src/c", "db/sql"): ("unknown", None, "ask for a file of src/c"), ("src/c/p.py", "requests.api"): ("no", "net", "fix"), ("src/c/q.go", "requests.api"): ("yes", None, None),
    ("a", "requests"): ("unknown", "net", "ask for a file of a"), ("src/a/x.go", "net/url"): ("yes", None, None), ("src/a/x.go", "net"): ("no", "net", "fix"), ("a", "go.uber.org/zap"): ("yes", None, None),
}


def test_answers(spark):
    pairs = list(CASES)
    got = ask(spark, pairs)
    found = {p: (r["answer"], r["rule"], r["next"]) for p, r in zip(pairs, got, strict=True)}
    assert {p: found[p] for p in pairs if found[p] != CASES[p]} == {}
    by = dict(zip(pairs, got))
    legacy = by["src/a", "src/d/legacy"]
    assert (legacy["what"], legacy["why"], legacy["instead"], legacy["from"], legacy["to"], legacy["balance"]) == ("a -/-> src/d/legacy/**", "it goes away", "use d", "a", "d", None)
    assert by["a", "b"]["balance"] == 9
    assert by["a", "a"]["balance"] is None and by["src/a/x_test.go", "src/d/legacy/o.go"]["balance"] is None
    assert by["a", "db/sql"]["what"] == "only for b, src/c/q.go" and by["a", "db/sql"]["why"] == "one place"
    assert by["src/d", "src/b/api"]["what"] == "the files of src/d answer differently"


def test_exceptions_that_hold(spark):
    pairs = [("src/a/x.go", "src/d/legacy/o.go"), ("a", "db/sql")]
    assert [r["rule"] for r in ask(spark, pairs, [("no-legacy", "a", "d")])] == ["coupling", "sql"]
    assert [r["answer"] for r in ask(spark, pairs, [("no-legacy", "a", None), ("coupling", "a", "d"), ("sql", "a", None)])] == ["yes", "yes"]


def test_modes_and_odd_questions(spark):
    got = ask(spark, [("a", "top"), (None, "a"), ("a", ""), ("a", "b"), ("a", "b"), ("gen", "b")], modes={"graph": "off"}, rules=[])
    assert [r["answer"] for r in got] == ["yes", None, None, "yes", "yes", "yes"] and got[1]["what"] == "name both sides"


def test_clean(spark):
    cases = [("./a//b/", "a/b"), ("a/../b", "b"), ("../a", "../a"), (".", ""), ("a/./../../b", "../b"), ("/x", "x")]
    d = spark.createDataFrame(cases, "p string, want string")
    assert d.where(C.clean(F.col("p")) != F.col("want")).collect() == []


def test_questions_and_uses_are_read_once(spark):
    """What is asked, and the uses that it is made from, pass one scan, however many steps need them."""
    import os

    from tessera.plans import questions as P
    from tessera.plans.registry import Facts

    data = "/root/testdata/sf0.001"
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    once = F.udf(count).asNondeterministic()
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(CASES)], "id int, from string, to string").withColumn("from", once("from"))
    public = spark.createDataFrame([("b", glob_regex("src/b/api/**"))], "module string, regex string")
    modules = spark.createDataFrame(MODULES, "module string, volatility string, subdomain string, layer_pos int")
    files, depends = spark.createDataFrame(FILES, "file string, class string"), spark.createDataFrame(DEPENDS, "module string, target string")
    out = C.can(asked, files, paths_table(spark, GLOBS), modules, depends, public, C.rules_table(spark, RULES, list("abcd")))
    assert len(out.collect()) == len(CASES) == seen.value
    if not os.path.isdir(data):
        return
    seen.value = 0

    class Counted(Facts):
        @property
        def uses(self):
            return super().__getattr__("uses").withColumn("file", once("file"))

    facts = Counted(spark, data)
    rows = P.can_questions(facts)
    assert not any("lineitem" in f for f in rows.inputFiles())
    assert rows.count() > 0 and seen.value == Facts(spark, data).uses.count()
