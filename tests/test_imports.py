"""Imports of Go and script files."""

from pyspark.sql import functions as F

from tessera.sources import imports as I


def test_go(spark):
    text = '// Package p\npackage p\n\nimport "fmt"\nimport (\n\t. "a.b/c" /* "no" */\n\tx `a.b/c/d`; "a.b/cc"\n)\nimport "C"\nvar s = "a.b/c"\nimport "late"\n'
    texts = {"go.mod": "module a.b/c\n", "sub/go.mod": '  module "a.b/c/d"\n', "p.go": text, "p_test.go": text, "n.go": None, "sub/q.go": "package q\nimport \"a.b/c/d\"; import \"a.b/c/gone\"\n", "v.go": 'import "a.b/c/vendor/x"'}
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    got = I.go_targets(I.go_imports(files), I.go_modules(files), files, ["vendor/**"])
    assert sorted((r["file"], r["line"], r["path"], r["kind"], r["package"]) for r in got.collect()) == [
        ("p.go", 4, "fmt", "external", None), ("p.go", 6, "a.b/c", "first_party", ""), ("p.go", 7, "a.b/c/d", "first_party", "sub"), ("p.go", 7, "a.b/cc", "external", None), ("p.go", 9, "C", "external", None),
        ("sub/q.go", 2, "a.b/c/d", "first_party", "sub"), ("sub/q.go", 2, "a.b/c/gone", "unresolved", "gone"),
    ]


def test_script(spark):
    want = {
        "./b": ("file", "src/b.js"), "./b.js": ("file", "src/b.ts"), "./c": ("file", "src/c/index.tsx"), "../x.json": ("file", "x.json"), "./gone": ("unknown", None), "../../up": ("unknown", None), "../node_modules/k": ("external", None),
        "node:fs": ("external", None), "react": ("external", None), "@s/p": ("file", "packages/p/lib/main.ts"), "@s/p/deep": ("file", "packages/p/deep.ts"), "@s/p/none": ("unknown", None), "~/b": ("file", "src/b.js"), "~/z": ("unknown", None),
        "~/c/d": ("file", "src/c/d.mjs"), "exact": ("file", "x.json"), "#in": ("unknown", None), "/abs": ("unknown", None), "mod/k": ("external", None), "./b?url": ("file", "src/b.js"),
    }
    there = ["src/b.ts", "src/b.js", "src/c/index.tsx", "src/c/d.mjs", "x.json", "packages/p/lib/main.ts", "packages/p/deep.ts"]
    text = "\n".join(f"import y from '{s}'" for s in want)
    files = spark.createDataFrame([("src/a.ts", text), *((t, "") for t in there)], "file string, text string")
    packages = spark.createDataFrame([("@s/p", "packages/p", "lib/main.js")], "name string, dir string, entry string")
    aliases = [("~/*", ["src/*"]), ("~/c/*", ["other/*", "src/c/*"]), ("exact", ["x.json"]), ("mod/*", ["node_modules/m/*"])]
    got = I.script_targets(I.script_imports(files), files, packages, aliases)
    assert {r["spec"]: (r["kind"], r["target"]) for r in got.collect()} == want
    d = spark.createDataFrame([("a.mjs", "import 'one'\nimport('two'); x.import('no'); import(`no`)\n/* import 'no' */ export {k} from \"three\" // from 'no'\nconst from = 'no', s = \"import 'no'\"\nrequire('four', 5)\nimport type { T } from 'five'")], "file string, text string")
    assert [r["spec"] for r in I.script_imports(d).collect()] == ["one", "two", "three", "four", "five"]
    assert I.script_targets(I.script_imports(d.limit(0)), files).count() == 0


def test_files_meet_bases_by_stem(spark):
    """Every try of a base has one of its stems; names that end in .d, index or a dot lose none."""
    bases = ["a", "a.js", "a.d", "a.d.d", "a/index", "a/index.js", "a.d/index", "a.d.js", "x.y", "x.y.mjs", ".", "a.", "a.vue", "a.d.ts"]
    df = spark.createDataFrame([(b,) for b in bases], "base string")
    rows = df.select("base", I._stems(F.col("base")).alias("stems"), F.explode(I._tries(F.col("base"))).alias("file")).withColumn("stem", I._stem(F.col("file")))
    assert rows.where("NOT array_contains(stems, stem)").collect() == []
    assert rows.where("size(stems) > 3").count() == 0
