"""Coverage reports and source files, written from order rows and read back; the oracles count the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import request
from ..sources import code, coverage, extract, imports, placing, syntax, units
from .registry import Facts, query

EXTENSIONS = ["info", "out", "json", "json", "xml"]


def reports(f: Facts):
    """A report an order, in one of the five formats: a file a supplier, a line a part, hits by quantity."""
    rows = f.lineitem.select("l_orderkey", F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), (F.col("l_partkey") + 1).cast("string").alias("at"), (F.col("l_quantity").cast("int") % 3).alias("hits"), (F.col("l_linenumber") + 1).cast("string").alias("n"))
    hits = F.col("hits").cast("string")
    k = F.col("l_orderkey") % 5
    line = (
        F.when(k == 0, F.concat(F.lit("DA:"), "at", F.lit(","), hits, F.lit("\n")))
        .when(k == 1, F.concat("file", F.lit(":"), "at", F.lit(".1,"), "at", F.lit(".9 "), "n", F.lit(" "), hits, F.lit("\n")))
        .when(k == 4, F.concat(F.lit('<line number="'), "at", F.lit('" hits="'), hits, F.lit('"/>')))
    )
    # dealt once by order: both groupings stay where the rows are
    dealt = rows.select("l_orderkey", "file", line.alias("line"), "hits").repartition("l_orderkey")
    made = dealt.groupBy("l_orderkey", "file").agg(
        F.array_join(F.array_sort(F.collect_list("line")), "").alias("lines"),
        F.count_if(F.col("hits") > 0).cast("string").alias("c"), F.count_if(F.col("hits") == 0).cast("string").alias("m"), F.count("*").cast("string").alias("t"),
    )
    part = (
        F.when(k == 0, F.concat(F.lit("SF:"), "file", F.lit("\n"), "lines", F.lit("end_of_record\n"))).when(k == 1, F.col("lines"))
        .when(k == 2, F.concat(F.lit('"'), "file", F.lit('": {"summary": {"covered_lines": '), "c", F.lit(', "missing_lines": '), "m", F.lit("}}")))
        .when(k == 3, F.concat(F.lit('{"filename": "'), "file", F.lit('", "summary": {"lines": {"covered": '), "c", F.lit(', "count": '), "t", F.lit("}}}")))
        .otherwise(F.concat(F.lit('<class filename="'), "file", F.lit('"><lines>'), "lines", F.lit("</lines></class>")))
    )
    whole = made.withColumn("part", part).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("part")).alias("p"))
    text = (
        F.when(k == 0, F.array_join("p", "")).when(k == 1, F.concat(F.lit("mode: count\n"), F.array_join("p", "")))
        .when(k == 2, F.concat(F.lit('{"files": {'), F.array_join("p", ","), F.lit("}}"))).when(k == 3, F.concat(F.lit('{"data": [{"files": ['), F.array_join("p", ","), F.lit("]}]}")))
        .otherwise(F.concat(F.lit("<coverage><packages><package><classes>"), F.array_join("p", ""), F.lit("</classes></package></packages></coverage>")))
    )
    ext = F.array(*map(F.lit, EXTENSIONS))[k.cast("int")]
    return whole.select(F.col("l_orderkey").alias("report"), F.concat(F.lit("r."), ext).alias("path"), text.alias("text"))


COVERED = """WITH r AS (SELECT l_orderkey AS report, l_orderkey % 5 AS k, 'f' || l_suppkey AS file, l_partkey AS line, CAST(l_quantity AS INT) % 3 AS hits, l_linenumber + 1 AS n FROM lineitem),
l AS (SELECT report, k, file, line, max(hits) AS hits FROM r WHERE k IN (0, 4) GROUP BY ALL)
SELECT report, CASE k WHEN 0 THEN 'lcov' ELSE 'cobertura' END AS format, file, (count(*) FILTER (hits > 0))::BIGINT AS covered, count(*)::BIGINT AS total, 'lines' AS unit FROM l GROUP BY report, k, file
UNION ALL SELECT report, CASE k WHEN 1 THEN 'go' WHEN 2 THEN 'coverage_py' ELSE 'llvm_cov' END, file, sum(CASE WHEN hits = 0 THEN 0 WHEN k = 1 THEN n ELSE 1 END)::BIGINT, sum(CASE WHEN k = 1 THEN n ELSE 1 END)::BIGINT, CASE k WHEN 1 THEN 'statements' ELSE 'lines' END FROM r WHERE k IN (1, 2, 3) GROUP BY report, k, file"""


@query("coverage_reports", COVERED)
def coverage_reports(f):
    return coverage.facts(reports(f))


def _file(f: Facts, extension: str, a, n, r):
    """A source file an order; a row gives one text by its flag, in the order of the rows."""
    part = F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "N", n).otherwise(r)
    rows = f.lineitem.withColumn("id", F.col("l_linenumber").cast("string")).select("l_orderkey", F.struct("l_linenumber", "l_returnflag", part.alias("t")).alias("p"))
    rows = rows.repartition("l_orderkey")  # lines before they are gathered: lists are made once
    text = F.array_join(F.transform(F.array_sort("p"), lambda x: x["t"]), "\n")
    return rows.groupBy("l_orderkey").agg(F.collect_list("p").alias("p")).select(F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit("." + extension)).alias("file"), text.alias("text"))


def _c(*parts):
    return F.concat(*(F.col("id") if x is None else F.lit(x) for x in parts))


def sources(f: Facts):
    py = _file(f, "py", _c("import m", None), _c("def f", None, "(a):\n    # import no\n    import x", None), _c("y = importlib.import_module('z", None, "')"))
    ts = _file(f, "ts", _c('import { a } from "m', None, '"'), _c('const x = require("n', None, '"); void import("y")'), _c('/* require("a")\nmyrequire("b") import("c") */'))
    return py.unionByName(ts)


@query("dynamic_imports", """WITH l AS (SELECT l_orderkey AS o, l_returnflag AS r, sum(CASE l_returnflag WHEN 'N' THEN 3 ELSE 1 END) OVER w AS py, sum(CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END) OVER w AS ts FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING))
SELECT 'src/o' || o || '.py' AS file, py::BIGINT AS line, CASE r WHEN 'N' THEN 'lazy_import' ELSE 'importlib' END AS kind FROM l WHERE r <> 'A'
UNION ALL SELECT 'src/o' || o || '.ts', ts::BIGINT, unnest(['require', 'dynamic_import']) FROM l WHERE r = 'N'""")
def dynamic_imports(f):
    return code.dynamic_imports(sources(f))


@query("python_imports", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r, sum(CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING) AS line FROM lineitem),
m AS (SELECT DISTINCT l_orderkey AS o FROM lineitem), x AS (SELECT o, line - CASE r WHEN 'N' THEN 1 ELSE 0 END AS line, r, i FROM l)
SELECT 'pkg/m' || o || '.py' AS file, line::BIGINT AS line, CASE WHEN r = 'N' THEN 'pkg.m' || (o + i) ELSE 'os.path' END AS module, CASE WHEN r = 'N' THEN 'pkg/m' || (o + i) || '.py' END AS target, CASE WHEN r = 'N' THEN 'file' ELSE 'external' END AS kind FROM x WHERE r <> 'N' OR (o + i) IN (SELECT o FROM m)
UNION ALL SELECT 'pkg/m' || o || '.py', line::BIGINT, 'pkg', 'pkg/__init__.py', 'file' FROM x WHERE r = 'N' AND (o + i) NOT IN (SELECT o FROM m)
UNION ALL SELECT 'pkg/m' || o || '.py', (line + 1)::BIGINT, 'pkg', 'pkg/__init__.py', 'file' FROM x WHERE r = 'N'""")
def python_imports(f):
    near = F.concat(F.lit("from . import (m"), (F.col("l_orderkey") + F.col("l_linenumber")).cast("string"), F.lit(",\n  name as n)"))
    files = _file(f, "py", F.lit("import os.path as p"), near, F.lit("import os.path  # pkg"))
    files = files.select(F.regexp_replace("file", "^src/o", "pkg/m").alias("file"), "text")
    start = f.spark.range(1).select(F.lit("pkg/__init__.py").alias("file"), F.lit("").alias("text"))
    files = files.unionByName(start)
    return code.python_targets(code.python_imports(files), code.python_modules(files.select("file"), ["pkg"]))


@query("retractions", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r FROM lineitem)
SELECT 'o' || o || '/go.mod' AS file, 'retract' AS kind, CASE r WHEN 'A' THEN 'v1.0.' || i ELSE '[v2.0.' || i || ', v2.1.0]' END AS subject, CASE r WHEN 'A' THEN 'bad ' || i ELSE '' END AS note FROM l WHERE r <> 'R'""")
def retractions(f):
    files = _file(f, "mod", _c("retract v1.0.", None, " // bad ", None), _c("retract (\n\t// none\n\t[v2.0.", None, ", v2.1.0]\n)"), _c("require m v1.", None))
    return code.retractions(files.select(F.regexp_replace("file", "^src/(o[0-9]+)[.]mod$", "$1/go.mod").alias("file"), "text"))


@query("deprecated_packages", """SELECT 'p' || p_partkey || '/package.json' AS file, 'deprecated' AS kind, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'p' || p_partkey || '/package.json' END AS subject, p_type AS note FROM part WHERE p_size % 2 = 0""")
def deprecated_packages(f):
    text = F.to_json(F.struct(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("deprecated")))
    return code.deprecated(f.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/package.json")).alias("file"), text.alias("text")))


#: Paths and the class that each has, by the language of its extension (fixed cases).
CLASSES = [("vendor/a{}.go", "vendor"), ("src/a{}_test.go", "test"), ("src/mocks/m{}.go", "generated"), ("src/x{}.pb.go", "generated"), ("tests/a{}.py", "test"), ("src/tests/a{}.go", "production"), ("src/gen_{}.ts", "generated"), ("src/a{}.spec.ts", "test"), ("src/a{}.d.ts", "generated"),
           ("a/property_tests/b{}.rs", "test"), ("a/Obj{}.cs", "production"), ("a/obj/b{}.cs", "generated"), ("a/bin/b{}.py", "production"), ("a/Mocks/b{}.cs", "generated"), ("a/Tests/b{}.cs", "test"), ("a/b{}.G.I.cs", "generated"), ("custom/b{}.go", "generated"), ("e2e/b{}.go", "test"), ("src/main{}.go", "production")]


@query("file_class", "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(CLASSES)) + f""") c(i, class)) SELECT 'src' || doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN 'generated' ELSE class END AS class FROM documents JOIN c ON i = doc_id % {len(CLASSES)}""")
def file_class(f):
    path = F.replace(F.array(*(F.lit(p) for p, _ in CLASSES))[(F.col("doc_id") % len(CLASSES)).cast("int")], F.lit("{}"), F.col("doc_id").cast("string"))
    head = F.when(F.col("doc_id") % 11 == 0, "// Code generated by a tool. DO NOT EDIT.\n").otherwise("// Code generated\n")
    files = f.documents.select("doc_id", path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return files.select(F.concat(F.lit("src"), F.col("doc_id").cast("string")).alias("file"), code.file_class(F.col("path"), F.col("text"), generated=["custom/**"], tests=["e2e/"]).alias("class"))


@query("freshness", """WITH s AS (SELECT source, count(*) FILTER (text IS NULL) AS gone FROM documents GROUP BY source) SELECT source, CASE WHEN source = (SELECT max(source) FROM documents) THEN 'unverified' WHEN gone > 0 OR source = (SELECT min(source) FROM documents) THEN 'stale' ELSE 'matched' END AS freshness FROM s""")
def freshness(f):
    d = f.documents.select(F.col("source").alias("report"), F.col("doc_id").cast("string").alias("file"), "text")
    ends = d.agg(F.min("report").alias("first"), F.max("report").alias("last"))
    # the first source is attested with digests of other texts, the last by an older schema
    d = d.crossJoin(F.broadcast(ends))  # one row
    digest = F.sha2(F.when(F.col("report") == F.col("first"), "").otherwise(F.coalesce("text", F.lit(""))), 256)
    sidecars = d.select("report", F.when(F.col("report") == F.col("last"), "0").otherwise(code.SIDECAR).alias("schema")).distinct()
    return code.attested(sidecars, d.select("report", "file", digest.alias("digest")), d.select("file", "text"), d).select(F.col("report").alias("source"), "freshness")


@query("go_imports", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r, sum(CASE l_returnflag WHEN 'N' THEN 4 WHEN 'R' THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING) AS line FROM lineitem),
p AS (SELECT DISTINCT 'm' || (l_orderkey % 50) AS package FROM lineitem)
SELECT 'm' || (o % 50) || '/o' || o || '.go' AS file, line::BIGINT AS line, 'ex.org/app/m' || (i * 13) AS path, CASE WHEN 'm' || (i * 13) IN (SELECT package FROM p) THEN 'first_party' ELSE 'unresolved' END AS kind, 'm' || (i * 13) AS package FROM l WHERE r = 'A'
UNION ALL SELECT 'm' || (o % 50) || '/o' || o || '.go', (line - 1)::BIGINT, 'ex.org/apples', 'external', NULL FROM l WHERE r = 'N'""")
def go_imports(f):
    near = F.concat(F.lit('import _ "ex.org/app/m'), (F.col("l_linenumber") * 13).cast("string"), F.lit('"'))
    files = _file(f, "go", near, F.lit('import (\n\t// "c"\n\tx "ex.org/apples"\n)'), F.lit('/* import "a"\n*/ // import "b"'))
    key = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    files = files.select(F.concat(F.lit("m"), (key % 50).cast("string"), F.lit("/o"), key.cast("string"), F.lit(".go")).alias("file"), F.concat("text", F.lit('\nfunc f() { import "z" }')).alias("text"))
    mod = f.spark.range(1).select(F.lit("go.mod").alias("file"), F.lit("// app\nmodule ex.org/app\n\ngo 1.22\n").alias("text"))
    return imports.go_targets(imports.go_imports(files), imports.go_modules(mod), files)


@query("script_imports", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r, sum(CASE l_returnflag WHEN 'A' THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING) AS line FROM lineitem),
x AS (SELECT *, 'src/o' || (o + i) || '.ts' AS t, (o + i) IN (SELECT l_orderkey FROM lineitem) AS there FROM l)
SELECT 'src/o' || o || '.ts' AS file, line::BIGINT AS line, CASE r WHEN 'A' THEN '../src/o' || (o + i) WHEN 'N' THEN '@app/o' || (o + i) || '.js?raw' ELSE 'lib' || i || '/x' END AS spec, CASE WHEN r = 'R' THEN 'external' WHEN there THEN 'file' ELSE 'unknown' END AS kind, CASE WHEN r <> 'R' AND there THEN t END AS target FROM x""")
def script_imports(f):
    to = (F.col("l_orderkey") + F.col("l_linenumber")).cast("string")
    near = F.concat(F.lit('import { a, // from "b"\n b } from "../src/o'), to, F.lit('"'))
    files = _file(f, "ts", near, F.concat(F.lit("export * from '@app/o"), to, F.lit(".js?raw'")), _c('const p = `from "q"`, r = require("lib', None, '/x"); my.require("s")'))
    return imports.script_targets(imports.script_imports(files), files, aliases=[("@app/*", ["src/*"])])


@query("deploy_units", """SELECT 'svc/d' || p_partkey AS dir, CASE WHEN p_size % 7 = 0 AND p_size % 2 = 0 THEN 'mod' || p_partkey WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 2 = 0 THEN 'd' || p_partkey ELSE p_name END AS unit,
CASE WHEN p_size % 7 = 0 AND p_size % 2 = 0 THEN 'go_main' WHEN p_size % 3 = 0 THEN 'pyproject' WHEN p_size % 2 = 0 THEN 'dockerfile' ELSE 'k8s' END AS source FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0""")
def deploy_units(f):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    d = F.concat(F.lit("svc/d"), key)
    def shown(when, name, text):
        return F.when(size % when == 0, F.struct(F.concat(d, F.lit(f"/{name}")).alias("file"), text.alias("text")))

    project = F.concat(F.lit("[project]\nname = '"), "p_brand", F.lit("'\n[tool]\nname = 'x'\n"))
    deploy = F.concat(F.lit("kind: Service\n---\nkind: Deployment\nmetadata:\n  name: "), "p_name", F.lit("\n"))
    made = F.array(shown(7, "main.go", F.lit("// svc\npackage main\n")), shown(3, "pyproject.toml", project), shown(2, "Dockerfile", F.lit("FROM x\n")), shown(5, "a.yaml", deploy))
    files = f.part.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("x.file", "x.text")
    # a program counts at its module's root alone
    owners = f.part.select(d.alias("dir"), F.concat(F.lit("mod"), key).alias("module"), (size % 2 == 0).alias("is_root"))
    return units.units(files, owners)


TODAY = "1995-06-15"


@query("requests", f"""WITH e AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS "check", CASE WHEN o_orderkey % 9 = 0 THEN 'no verdict' WHEN n IS NULL THEN 'nothing to ask' WHEN o_orderkey % 4 = 0 OR (x > greatest(d, DATE '{TODAY}') AND x <= DATE '{TODAY}' + 365) THEN 'request' ELSE 'bad date' END AS outcome, CASE WHEN o_orderkey % 9 <> 0 AND (o_orderkey % 4 = 0 OR (x > greatest(d, DATE '{TODAY}') AND x <= DATE '{TODAY}' + 365)) THEN coalesce(n, 0) ELSE 0 END::INT AS asked
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 200 AS x FROM orders) LEFT JOIN e ON o = o_orderkey""")
def requests(f):
    day = F.col("o_orderdate").cast("date")
    checks = f.orders.select(F.col("o_orderkey").alias("check"), F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise("fail").alias("status"), day.alias("date"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(day, 200)).alias("expires"))
    next_ = F.when(F.col("l_returnflag") == "R", "command").otherwise("fix")
    errors = f.lineitem.select(F.col("l_orderkey").alias("check"), next_.alias("next"), F.lit("graph").alias("rule"), F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"), F.lit("f").alias("file"), F.col("l_linenumber").alias("line"))
    out = request.requests(checks, errors, TODAY)
    return out.select("check", "outcome", F.coalesce(F.size("errors"), F.lit(0)).alias("asked"))


#: Where each format writes its paths: below a module, from the root of the disk, from here, with back slashes, and on another drive.
WRITES = {"go": "ex.org/app/", "lcov": "/repo/", "coverage_py": "./", "cobertura": "lib\\", "llvm_cov": "D:/repo/"}
HERE = "CASE format WHEN 'llvm_cov' THEN false ELSE s_acctbal >= 0 END"


def placed_reports(f: Facts):
    facts = coverage.facts(reports(f))
    lead = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in WRITES.items() for x in kv)), F.col("format")), F.lit(""))
    facts = facts.withColumn("file", F.concat(lead, "file"))
    return placing.placed(facts, tree_files(f), f.spark.createDataFrame([("ex.org/app", "")], "path string, dir string"), "/repo", "lib")


def tree_files(f: Facts):
    """A file a supplier that has no debts, in the module of its nation; those of every third are tests."""
    s = f.supplier.where("s_acctbal >= 0").join(f.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), F.col("n_name").alias("module"), F.when(F.col("s_suppkey") % 3 == 0, "test").otherwise("production").alias("class"))


@query("coverage_unresolved", f"WITH f AS ({COVERED}), p AS (SELECT report, file, {HERE} AS here FROM f JOIN supplier ON file = 'f' || s_suppkey) SELECT report, count(DISTINCT file)::BIGINT AS named, (count(DISTINCT file) FILTER (NOT here))::BIGINT AS unresolved FROM p GROUP BY report")
def coverage_unresolved(f):
    return placing.unresolved(placed_reports(f))


@query("coverage_modules", f"""WITH f AS ({COVERED}), p AS (SELECT f.* FROM f JOIN supplier ON file = 'f' || s_suppkey WHERE {HERE}), t AS (SELECT 'f' || s_suppkey AS file, n_name AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0 AND s_suppkey % 3 <> 0),
r AS (SELECT file, unit, CASE WHEN min(total) = max(total) THEN max(covered) END AS covered, CASE WHEN min(total) = max(total) THEN max(total) END AS total, min(total) <> max(total) AS bad FROM p GROUP BY file, unit),
n AS (SELECT module, count(*)::BIGINT AS files FROM t GROUP BY module), m AS (SELECT module, unit, count(*)::BIGINT AS measured, (count(*) FILTER (bad))::BIGINT AS incompatible, sum(covered)::BIGINT AS covered, sum(total)::BIGINT AS total FROM t JOIN r USING (file) GROUP BY module, unit)
SELECT module, unit, files, coalesce(measured, 0)::BIGINT AS measured, coalesce(incompatible, 0)::BIGINT AS incompatible, covered, total, CASE WHEN total > 0 THEN round(covered / total, 6) END AS share FROM n LEFT JOIN m USING (module)""")
def coverage_modules(f):
    return placing.rolled_up(tree_files(f), placing.reconciled(placed_reports(f)))


_GO_LINES = """l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r, CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 4 ELSE 1 END AS n FROM lineitem),
t AS (SELECT *, sum(n) OVER (PARTITION BY o ORDER BY i, r ROWS UNBOUNDED PRECEDING) AS stop FROM l)"""


def go_sources(f: Facts):
    """A Go file an order; each line is a method, a type, or a text that looks like a function."""
    a = _c("func (t *T) f", None, "(a map[string]int) (int, error) {\n\tif a != nil { // }\n\t\tx := `}`; go func() { _ = '{' }()\n\t}\n}")
    n = _c("type T", None, ' struct {\n\tx string /* { */\n\ty map[string]struct{ z int }\n}')
    return _file(f, "go", a, n, _c("var s", None, ' = "func g() {" // func h() {'))


@query("syntax_ranges", f"""WITH {_GO_LINES} SELECT 'src/o' || o || '.go' AS file, CASE r WHEN 'A' THEN 'function' ELSE 'type' END AS kind, CASE r WHEN 'A' THEN 'f' ELSE 'T' END || i AS name, (stop - n + 1)::BIGINT AS start, stop::BIGINT AS "end" FROM t WHERE r IN ('A', 'N')
UNION ALL SELECT 'src/o' || o || '.go', 'function', '', (stop - 2)::BIGINT, (stop - 2)::BIGINT FROM t WHERE r = 'A'""")
def syntax_ranges(f):
    return syntax.ranges(go_sources(f))


@query("function_ranges_length", f"""WITH {_GO_LINES}, x AS (SELECT o, 5 AS size FROM t WHERE r = 'A' UNION ALL SELECT o, 1 FROM t WHERE r = 'A'), k AS (SELECT DISTINCT o, o % 20 AS m FROM t),
n AS (SELECT m, count(*)::BIGINT AS files FROM k GROUP BY m), s AS (SELECT m, count(*)::BIGINT AS functions, quantile_disc(size, 0.5)::BIGINT AS p50, quantile_disc(size, 0.9)::BIGINT AS p90, max(size)::BIGINT AS longest, (count(*) FILTER (size > 4))::BIGINT AS over FROM x JOIN k USING (o) GROUP BY m)
SELECT 'm' || m AS module, files, files AS observed, coalesce(functions, 0)::BIGINT AS functions, p50, p90, longest, coalesce(over, 0)::BIGINT AS over FROM n LEFT JOIN s USING (m)""")
def function_ranges_length(f):
    files = go_sources(f)
    owned = files.select("file", F.concat(F.lit("m"), (F.regexp_extract("file", "([0-9]+)", 1).cast("long") % 20).cast("string")).alias("module"))
    return syntax.lengths(syntax.ranges(files), owned, over=4)


@query("extract_facts", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS r, sum(CASE l_returnflag WHEN 'N' THEN 3 ELSE 1 END) OVER w AS py, sum(CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END) OVER w AS ts, sum(CASE l_returnflag WHEN 'N' THEN 4 WHEN 'R' THEN 2 ELSE 1 END) OVER w AS go FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING))
SELECT 'src/o' || o || '.py' AS file, 'import' AS kind, py::BIGINT AS line, CASE r WHEN 'A' THEN 'm' ELSE 'x' END || i AS subject FROM l WHERE r <> 'R'
UNION ALL SELECT 'src/o' || o || '.py', CASE r WHEN 'N' THEN 'lazy_import' ELSE 'importlib' END, py::BIGINT, NULL FROM l WHERE r <> 'A'
UNION ALL SELECT 'src/o' || o || '.ts', 'import', ts::BIGINT, unnest(CASE r WHEN 'A' THEN ['m' || i] ELSE ['n' || i, 'y'] END) FROM l WHERE r <> 'R'
UNION ALL SELECT 'src/o' || o || '.ts', unnest(['require', 'dynamic_import']), ts::BIGINT, NULL FROM l WHERE r = 'N'
UNION ALL SELECT 'src/o' || o || '.go', 'import', (go - CASE r WHEN 'N' THEN 1 ELSE 0 END)::BIGINT, CASE r WHEN 'A' THEN 'ex.org/m' || i ELSE 'ex.org/apples' END FROM l WHERE r <> 'R'""")
def extract_facts(f):
    go = _file(f, "go", _c('import _ "ex.org/m', None, '"'), F.lit('import (\n\t// "c"\n\tx "ex.org/apples"\n)'), F.lit('/* import "a"\n*/ // import "b"'))
    extract.register(f.spark)
    return f.spark.sql("SELECT t.file, x.kind, x.line, x.subject FROM {texts} t, LATERAL code_facts(t.file, t.text) x", texts=sources(f).unionByName(go))
