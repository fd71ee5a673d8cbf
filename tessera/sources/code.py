"""Facts from source files and manifests: imports, classes, retractions, attestations.

files: (file, text), one row a file.  Scans that need a stack or a grammar read Arrow batches of files; a null text has
no facts.  Everything that joins or compares is in DataFrames.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from .lookup import looked_up
from .scratch import cut

#: Languages by extension, attestation schema.
LANGUAGES = {"go": ["go"], "python": ["py"], "typescript": ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"], "rust": ["rs"], "dotnet": ["cs"]}
SIDECAR = "1"


#: Rows that a task gathers before it hands them on: its memory does not follow what a batch of texts holds.
GATHERED = 8192


def scanned(files: DataFrame, schema: str, find) -> DataFrame:
    """(file, ...) of what find(text) yields for each text that is not null; find may differ by language, all in one pass."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64()}
    arrow = pa.schema([("file", pa.string())] + [(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
    by = find if isinstance(find, dict) else {"": find}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in source:
            for file, text, lang in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not text.is_valid:
                    continue
                file = file.as_py()
                for found in by[lang.as_py()](text.as_py()):
                    rows.append((file, *found))
                    if len(rows) >= GATHERED:
                        yield made(rows)
                        rows = []
        yield made(rows)

    if isinstance(find, dict):
        rows = files.select("file", "text", language(F.col("file")).alias("_lang")).where(F.col("_lang").isin(*by))
    else:
        rows = files.select("file", "text", F.lit("").alias("_lang"))
    return rows.mapInArrow(batches, f"file string, {schema}")


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.when(F.lit(False), "")
    for name, found in LANGUAGES.items():
        out = out.when(ext.isin(found), name)
    return out.otherwise("")


def is_test(path: Column) -> Column:
    """Test file by the conventions of the path's language."""
    lang = language(path)
    return (
        ((lang == "go") & path.rlike(r"_test\.go$"))
        | ((lang == "python") & path.rlike(r"(?:^|/)test_[^/]*$|_test\.py$|(?:^|/)tests/"))
        | ((lang == "typescript") & path.rlike(r"\.(?:test|spec)\.[^/]*$|(?:^|/)__tests__/"))
        | ((lang == "rust") & path.rlike(r"(?:^|/)tests\.rs$|_tests?\.rs$|(?:^|/)(?:tests|benches|[^/]*[_-]tests)/"))
        | ((lang == "dotnet") & path.rlike(r"Tests?\.cs$|(?i)(?:^|/)tests?/"))
    )


def _named(path: Column, globs: list[str]) -> Column:
    """A glob names the path or its last part; one that ends in a slash names a directory at any depth."""
    out = F.lit(False)
    for g in globs:
        if g.endswith("/"):
            out |= F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{g}")
        else:
            out |= path.rlike(glob_regex(g)) | F.regexp_extract(path, "([^/]*)$", 1).rlike(glob_regex(g))
    return out


def file_class(path: Column, text: Column, generated=(), tests=()) -> Column:
    """generated, vendor, test or production: header, names, configured globs, directories and conventions in that order."""
    head = F.substring(text, 1, 512)  # the marker counts in the header alone
    net = language(path) == "dotnet"
    marked = (head.contains("Code generated") & head.contains("DO NOT EDIT")) | (net & head.contains("<auto-generated"))
    named = path.rlike(r"\.pb\.go$|\.d\.[mc]?ts$|(?:^|/)(?:gen_|mock_)[^/]*$|(?:_gen|_mock|_moq|_pb2|\.gen)(?:\.[^./]*)?$|(?i:\.(?:g|g\.i|designer)\.cs)$")
    mocks = path.rlike(r"(?:^|/)(?:mocks|__mocks__)(?:/|$)") | (net & path.rlike(r"(?i)(?:^|/)mocks/|(?-i)(?:^|/)(?:obj|bin)/"))
    return (
        F.when(F.coalesce(marked, F.lit(False)) | named | _named(path, list(generated)) | mocks, "generated")
        .when(path.rlike("(?:^|/)vendor(?:/|$)"), "vendor").when(is_test(path) | _named(path, list(tests)), "test").otherwise("production")
    )


_CALL = re.compile(r"\b(?:importlib\.import_module|__import__)\s*\(")
_DEF = re.compile(r"(?:async )?def ")


def python_lazy(text: str):
    """(line, kind): imports inside a function by indentation, and calls of the import machinery."""
    inside = []  # columns of the functions that are open
    for at, raw in enumerate(text.split("\n"), 1):
        body = raw.lstrip(" \t")
        if not body or body[0] == "#":
            continue
        column = len(raw) - len(body)
        while inside and column <= inside[-1]:
            inside.pop()
        if _CALL.search(body):
            yield at, "importlib"
        elif inside and body.startswith(("import ", "from ")):
            yield at, "lazy_import"
        if _DEF.match(body):
            inside.append(column)


_LAZY = {"require": re.compile(r"\brequire\s*\("), "dynamic_import": re.compile(r"\bimport\s*\(")}


def script_lazy(text: str):
    """(line, kind): calls of require and import outside lines of comment."""
    comment = False
    for at, raw in enumerate(text.split("\n"), 1):
        body = raw.strip()
        if comment:
            comment = "*/" not in body
        elif body.startswith("/*"):
            comment = "*/" not in body[2:]
        elif not body.startswith(("//", "*")):
            yield from ((at, kind) for kind, call in _LAZY.items() if call.search(body))


def dynamic_imports(files: DataFrame) -> DataFrame:
    """(file, line, kind) of imports that run late, in Python and script files that are no tests."""
    path = F.col("file")
    files = files.where(~is_test(path) & ~path.rlike("(?:^|/)testdata/"))
    return scanned(files, "line bigint, kind string", {"python": python_lazy, "typescript": script_lazy})


_STATEMENT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)|import[ \t]+([^\n#;]+))", re.M)


_QUOTES = re.compile(r"(\"\"\"|''')[\s\S]*?(?:\1|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|#[^\n]*")


def _loose(text: str):
    """Imports of a text that is no valid Python now: statements by their form, outside strings and comments."""
    text = _QUOTES.sub(lambda q: re.sub(r"[^\n]", " ", q[0]), text)
    for m in _STATEMENT.finditer(text):
        base = m[1]
        at = m.start(2 if base else 3)
        for part in re.finditer(r"[^,()]+", re.sub(r"#[^\n]*", lambda c: " " * len(c[0]), m[2] or m[3])):
            name = part[0].split()
            if name and name[0] != "\\":
                yield text.count("\n", 0, at + part.start() + len(part[0]) - len(part[0].lstrip())) + 1, base, name[0]


def python_statements(text: str):
    """(line, base, name): `import name` has no base; `from base import name` keeps its leading dots."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from _loose(text)
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((a.lineno, None, a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            yield from ((a.lineno, base, a.name) for a in node.names)


def python_imports(files: DataFrame) -> DataFrame:
    """(file, line, base, name) of every import statement of Python files, in functions too."""
    return scanned(files.where(language(F.col("file")) == "python"), "line bigint, base string, name string", python_statements)


def _unparsed(text: str):
    try:
        ast.parse(text)
    except SyntaxError as e:
        yield e.lineno or 0, "does not parse"
    except (ValueError, RecursionError) as e:
        yield 0, str(e)[:80]


def python_problems(files: DataFrame) -> DataFrame:
    """(file, line, problem) of Python files that do not parse: their imports are found by form."""
    return scanned(files.where(language(F.col("file")) == "python"), "line bigint, problem string", _unparsed)


def python_modules(files: DataFrame, packages: list[str]) -> DataFrame:
    """(module, file) under the package directories, at the root or in src; a package's own file wins over a module of its name."""
    path = F.regexp_replace(F.regexp_extract("file", r"^(?:src/)?(.*)\.py$", 1), "(?:/|^)__init__$", "")
    found = files.where(F.col("file").rlike(r"^(?:[^\W\d]\w*/)+[^./]+\.py$")).select(F.replace(path, F.lit("/"), F.lit(".")).alias("module"), "file")
    found = found.where(F.substring_index("module", ".", 1).isin(packages))
    return found.groupBy("module").agg(F.max_by("file", F.struct(F.col("file").endswith("/__init__.py"), "file")).alias("file"))


def python_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, line, module, kind, target): a name is a submodule where there is one, else its base is imported.

    kind is `file`, `external` (no package of ours) or `unknown` (ours but not there, or a dot above the top)."""
    modules = cut(modules.select("module", "file"), "python-modules")  # read for each lookup
    known = modules.select("module", F.col("file").alias("target"))
    own = modules.select("file", F.col("module").alias("importer"))
    parts = F.split("importer", r"\.")
    level = F.length(F.regexp_extract("base", r"^(\.*)", 1))
    up = level - F.col("file").endswith("/__init__.py").cast("int")  # a package is its own first dot
    left = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    rest = F.regexp_replace("base", r"^\.+", "")
    base = F.when(F.col("base").isNull() | (level == 0), F.col("base")).when(F.size(parts) - up >= 1, F.concat_ws(".", left, F.when(rest != "", rest)))
    rows = imports.join(own, "file").withColumn("full", base).withColumn("lost", F.col("base").isNotNull() & F.col("full").isNull())
    sub = F.when(F.col("base").isNull(), F.col("name")).when(F.col("name") != "*", F.concat_ws(".", "full", "name"))
    rows = cut(rows.withColumn("sub", F.when(~F.col("lost"), sub)).select("file", "line", "base", "lost", "full", "sub"), "python-imports")
    # names that every file imports have most rows
    for name in ("sub", "full"):
        rows = looked_up(rows, known.select(F.col("module").alias(name), F.col("target").alias(f"_{name}")), name, f"_{name}")
    module = F.when(F.col("lost"), F.col("base")).when(F.col("base").isNull() | F.col("_sub").isNotNull(), F.col("sub")).otherwise(F.col("full"))
    target = F.coalesce("_sub", "_full")
    roots = modules.select(F.substring_index("module", ".", 1).alias("top")).distinct().withColumn("ours", F.lit(True))
    rows = cut(rows.select("file", "line", module.alias("module"), "lost", target.alias("target")).withColumn("top", F.substring_index("module", ".", 1)), "python-targets")
    rows = looked_up(rows, roots, "top", "ours")
    kind = F.when(F.col("target").isNotNull(), "file").when(F.col("lost") | F.col("ours").isNotNull(), "unknown").otherwise("external")
    return rows.select("file", "line", "module", kind.alias("kind"), "target").distinct()


def _retract_lines(text: str):
    block = False
    for raw in text.split("\n"):
        body = raw.strip()
        if not body or body.startswith("//"):
            continue
        if block and body == ")":
            block = False
            continue
        if not block:
            if not body.startswith("retract"):
                continue
            body = body[len("retract"):].strip()
            if body == "(":
                block = True
                continue
        subject, _, note = (x.strip() for x in body.partition("//"))
        if subject:
            yield "retract", subject, note


def retractions(files: DataFrame) -> DataFrame:
    """(file, kind, subject, note): versions that a go.mod takes back, alone or in a block."""
    return scanned(files.where(F.col("file").rlike(r"(?:^|/)go\.mod$")), "kind string, subject string, note string", _retract_lines)


def deprecated(files: DataFrame) -> DataFrame:
    """(file, kind, subject, note): a package.json that says in text that it is deprecated; its subject is the name or the file."""
    said = files.where(F.col("file").rlike(r"(?:^|/)package\.json$")).select("file", F.try_parse_json("text").alias("j"))
    note, name = (F.try_variant_get("j", f"$.{k}", "string") for k in ("deprecated", "name"))
    is_text = F.schema_of_variant(F.try_variant_get("j", "$.deprecated", "variant")) == "STRING"
    return said.where(is_text & (note != "")).select("file", F.lit("deprecated").alias("kind"), F.coalesce(F.nullif(name, F.lit("")), "file").alias("subject"), note.alias("note"))


def attested(sidecars: DataFrame, named: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """(report, freshness) of coverage reports.

    sidecars (report, schema), named (report, file, digest) the sources that they vouch for, files (file, text) as they
    are now, facts (report, file) as read.  unverified: no sidecar, another schema, no sources, a digest that is none, no
    facts; stale: a named file is gone or another, or a fact's file is not named; else matched."""
    now = files.select("file", F.sha2("text", 256).alias("now"))
    proof = named.join(now, "file", "left").groupBy("report").agg(
        F.bool_and(F.col("digest").rlike("^[0-9a-f]{64}$")).alias("valid"), F.bool_and(F.coalesce(F.col("now") == F.col("digest"), F.lit(False))).alias("same"))
    read = facts.select("report", "file").distinct()
    loose = read.join(named.select("report", "file").distinct(), ["report", "file"], "left_anti").select("report").distinct().withColumn("loose", F.lit(True))
    reports = read.select("report").distinct().withColumn("read", F.lit(True)).join(sidecars.select("report", "schema"), "report", "full")
    rows = reports.join(proof, "report", "left").join(loose, "report", "left")
    sure = (F.col("schema") == SIDECAR) & F.col("valid") & F.col("read")
    return rows.select("report", F.when(~F.coalesce(sure, F.lit(False)), "unverified").when(~F.col("same") | F.col("loose").isNotNull(), "stale").otherwise("matched").alias("freshness"))
