from tessera.sources import config as C
from tessera.sources import imports as I

FILES = {
    "tsconfig.json": '{ // root\n "extends": ["./base/one.json", "./base/two"], "compilerOptions": {"paths": {"#own/*": ["own/*"],},},}',
    "base/one.json": '{"compilerOptions": {"baseUrl": "../src", "paths": {"@one/*": ["one/*"]}}}',
    "base/two.json": '{"extends": "./three.json", "compilerOptions": {"baseUrl": "../lib"}}',
    "base/three.json": '{"compilerOptions": {"baseUrl": "../deep", "paths": {"@three": ["x/* not a comment */y"], "@t/*": ["t/*/a", "t/*/b"]}}}',
    "app/tsconfig.json": '{"extends": "../base/two.json" /* "paths" come from three */}',
    "app/pkg/tsconfig.json": '{"extends": "@cfg/strict"}', "app/node_modules/@cfg/strict/tsconfig.json": '{"compilerOptions": {"baseUrl": "."}}',
    "ring/a.json": '{"extends": "./b.json", "compilerOptions": {"baseUrl": "a"}}', "ring/b.json": '{"extends": "./c"}', "ring/c.json": '{"extends": "./a.json"}', "ring/tsconfig.json": '{"extends": "./c.json"}',
    "self/tsconfig.json": '{"extends": "./tsconfig.json"}', "lost/tsconfig.json": '{"extends": "./none"}', "bad/tsconfig.json": "{",
}


def options(spark):
    df = spark.createDataFrame(list(FILES.items()), "file string, text string").repartition(3)
    return C.inherited(C.compiler_options(df))


def test_inheritance(spark):
    got, problems = options(spark)
    by = {r.file: (r.base_url, [(a.pattern, a.into) for a in r.aliases or []]) for r in got.collect()}
    assert by["tsconfig.json"] == ("lib", [("#own/*", ["own/*"])])  # the last one listed is nearer than the first
    assert by["app/tsconfig.json"] == ("lib", [("@three", ["deep/x/* not a comment */y"]), ("@t/*", ["deep/t/*/a", "deep/t/*/b"])])
    assert by["app/pkg/tsconfig.json"] == ("app/node_modules/@cfg/strict", [])
    assert by["ring/a.json"] == ("ring/a", []) and by["ring/b.json"] == (None, []) and by["ring/tsconfig.json"] == (None, [])
    assert {(r.file, r.problem) for r in problems.collect()} == {("ring/a.json", "extends itself in a circle"), ("ring/b.json", "extends itself in a circle"), ("ring/c.json", "extends itself in a circle"), ("self/tsconfig.json", "extends itself in a circle"), ("lost/tsconfig.json", "extends no file: ./none"), ("bad/tsconfig.json", "cannot be read")}


def test_targets_by_directory(spark):
    files = spark.createDataFrame([(f,) for f in ["deep/t/k/b.ts", "lib/u.ts", "own/z.ts", "app/in/m.ts", "m.ts"]], "file string")
    uses = spark.createDataFrame([("app/in/m.ts", 1, "@t/k"), ("app/in/m.ts", 2, "u"), ("app/in/m.ts", 3, "#own/z"), ("m.ts", 4, "@t/k"), ("m.ts", 5, "u"), ("app/pkg/x.ts", 6, "u")], "file string, line long, spec string")
    opts = options(spark)[0].where("file LIKE '%tsconfig.json'")
    got = {r.line: (r.kind, r.target) for r in I.script_targets(uses, files, options=opts).collect()}
    assert got == {1: ("file", "deep/t/k/b.ts"), 2: ("file", "lib/u.ts"), 3: ("unknown", None), 4: ("external", None), 5: ("file", "lib/u.ts"), 6: ("external", None)}


def test_workspace_members(spark):
    text = "go 1.22\nuse ./tool // \"x\"\nuse (\n\t./svc/a\n\t./svc\n)\nreplace use => y\n"
    df = spark.createDataFrame([("go.work", text), ("sub/go.work", "use .")], "file string, text string")
    members = C.go_members(df)
    assert {(r.work, r.dir) for r in members.collect()} == {("go.work", "tool"), ("go.work", "svc/a"), ("go.work", "svc"), ("sub/go.work", "sub")}
    files = spark.createDataFrame([(f,) for f in ["svc/a/x.go", "svc/b/y.go", "svcs/z.go", "tool/t.go", "main.go"]], "file string")
    assert {r.file: r.member for r in C.member_of(files, members).collect()} == {"svc/a/x.go": "svc/a", "svc/b/y.go": "svc", "svcs/z.go": None, "tool/t.go": "tool", "main.go": None}


def test_scanner_knows_patterns_and_templates():
    text = 'const r = /"/; import y from "b"\nlet h = a / 2; const q = x.replace(/[/"]/g, `t${import("c")} ${`${require("d")}`} from "no"`); export * from "e"\nreturn /import "z"/.test(s); import "f"'
    assert list(I.script_statements(text)) == [(1, "b"), (2, "c"), (2, "d"), (2, "e"), (3, "f")]
