"""Imports of Go and script files, and the files or packages that they name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import directory
from ..functions.globs import glob_regex
from ..operators.uses import longest_prefix
from .code import language, scanned
from .lookup import looked_up
from .scratch import cut

_GO = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`([^`]*)`|\"((?:[^\"\\\n]|\\.)*)\"|\w+|[^\s\w]")


def go_statements(text: str):
    """(line, path) of the import specs, which stand before every other declaration."""
    state, at, line = "start", 0, 1
    for m in _GO.finditer(text):
        token = m[0]
        line += text.count("\n", at, m.start())
        at = m.start()
        if token.startswith(("//", "/*")):
            continue
        path = m[1] if m[1] is not None else m[2]
        if path is not None:
            if state in ("one", "many") and path:
                yield line, path
            state = "start" if state == "one" else state
        elif token == "import":
            state = "one"
        elif token == "(" and state == "one":
            state = "many"
        elif token == ")" and state == "many":
            state = "start"
        elif state == "start" and token in ("func", "type", "var", "const"):
            return


def go_imports(files: DataFrame) -> DataFrame:
    """(file, line, path) of Go files that are no tests."""
    go = files.where((language(F.col("file")) == "go") & ~F.col("file").endswith("_test.go"))
    return scanned(go, "line bigint, path string", go_statements)


def go_modules(files: DataFrame) -> DataFrame:
    """(dir, module) of go.mod files; dir is empty at the root."""
    mods = files.where(F.col("file").rlike(r"(?:^|/)go\.mod$"))
    name = F.regexp_extract("text", r"(?m)^\s*module\s+\"?([^\s\"/][^\s\"]*)", 1)
    return mods.select(F.regexp_extract("file", r"^(?:(.*)/)?go\.mod$", 1).alias("dir"), name.alias("module")).where("module <> ''")


def go_targets(imports: DataFrame, modules: DataFrame, files: DataFrame, exclude=()) -> DataFrame:
    """(file, line, path, kind, package): the module with the longest path decides.

    kind is `first_party`, `unresolved` (ours, but no source there) or `external`; packages that a glob excludes are left out."""
    imports = cut(imports, "go-imports")  # read three times
    where = longest_prefix(imports.select("path").distinct(), modules.select(F.col("module").alias("prefix")).distinct()).withColumnRenamed("prefix", "module")
    where = where.join(modules.groupBy("module").agg(F.min("dir").alias("dir")), "module", "left")
    rest = F.expr("substring(path, length(module) + 2)")
    package = F.array_join(F.filter(F.array("dir", rest), lambda x: x != ""), "/")
    where = where.select("path", F.when(F.col("module").isNotNull(), package).alias("package"))
    shown = F.coalesce("package", "path")
    where = where.where(~reduce(lambda c, g: c | shown.rlike(glob_regex(g)), exclude, F.lit(False)))
    go = files.where((language(F.col("file")) == "go") & ~F.col("file").endswith("_test.go"))
    sources = go.select(F.regexp_extract("file", "^(?:(.*)/)?[^/]*$", 1).alias("package")).distinct().withColumn("here", F.lit(True))
    where = where.join(sources, "package", "left")
    kind = F.when(F.col("package").isNull(), "external").when(F.col("here"), "first_party").otherwise("unresolved")
    known = where.select("path", F.struct(kind.alias("kind"), "package").alias("is"))
    return looked_up(imports, known, "path", "is").where("is IS NOT NULL").select("file", "line", "path", "is.kind", "is.package")


_SCRIPT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|[\w$]+|[^\s\w$]")
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words after which a slash opens a pattern; after other words, `)` and `]` it divides.
_OPENS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await", "instanceof"}


def script_statements(text: str):
    """(line, spec): static imports and exports, and calls of import and require with one literal, those in template substitutions too."""
    before, at, line, pos = [None, None, None], 0, 1, 0
    open_braces: list[int] = []  # of each template that a substitution stands in: braces open inside it
    while pos < len(text):
        last = before[-1]
        if text[pos] == "`" or (text[pos] == "}" and open_braces and not open_braces[-1]):
            if text[pos] == "}":
                open_braces.pop()
            pos += 1
            while pos < len(text) and text[pos] != "`" and not text.startswith("${", pos):
                pos += 2 if text[pos] == "\\" else 1
            if text.startswith("${", pos):
                open_braces.append(0)
                pos += 2
                before = [*before[-2:], "${"]
            else:
                pos += 1
                before = [*before[-2:], ""]
            continue
        if text[pos] == "/" and (last is None or last in _OPENS or (last and not (last[-1].isalnum() or last[-1] in "_$)]"))):
            if m := _PATTERN.match(text, pos):
                pos, before = m.end(), [*before[-2:], ""]
                continue
        m = _SCRIPT.match(text, pos)
        if not m:
            pos += 1
            continue
        pos, token = m.end(), m[0]
        line += text.count("\n", at, m.start())
        at = m.start()
        if token.startswith(("//", "/*")):
            continue
        if open_braces and token in "{}":
            open_braces[-1] += 1 if token == "{" else -1
        spec = m[1] if m[1] is not None else m[2]
        call = last == "(" and before[-2] in ("import", "require") and before[-3] != "."
        if spec and (call or (last in ("from", "import") and before[-2] != ".")):
            yield line, spec
        before = [*before[-2:], "" if spec is not None else token]


def script_imports(files: DataFrame) -> DataFrame:
    """(file, line, spec) of script files."""
    return scanned(files.where(language(F.col("file")) == "typescript"), "line bigint, spec string", script_statements)


#: What an extension in a specifier may stand for, and what is tried after a name, in this order.
STANDS_FOR = {
    ("js", "ts"): ["ts", "tsx", "d.ts", "js", "jsx"], ("jsx", "tsx"): ["tsx", "ts", "d.ts", "jsx", "js"],
    ("mjs", "mts"): ["mts", "d.mts", "mjs"], ("cjs", "cts"): ["cts", "d.cts", "cjs"],
}
TRIED = ["js", "cjs", "mjs", "jsx", "ts", "cts", "mts", "tsx", "d.ts", "json", "vue", "svelte"]


def normal(path: Column) -> Column:
    """A path without empty, `.` and `..` parts; null above the root."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, none, lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)))
    return F.array_join(up, "/")


def _tries(base: Column) -> Column:
    """Files that a name may mean, the first there wins."""
    ext, stem = F.regexp_extract(base, r"\.([^./]*)$", 1), F.regexp_replace(base, r"\.[^./]*$", "")
    same = reduce(lambda c, k: c.when(ext.isin(*k), F.array(*(F.concat(stem, F.lit(f".{x}")) for x in STANDS_FOR[k]))), STANDS_FOR, F.when(F.lit(False), F.array(base))).otherwise(F.array(base))
    after = [F.concat(base, F.lit(f".{x}")) for x in TRIED] + [F.concat(base, F.lit(f"/index.{x}")) for x in TRIED]
    return F.concat(same, F.array(*after))


def _stem(path: Column) -> Column:
    """A path without its last extension, `.d` before it, and a last part `index`: the key under which files and tries meet."""
    return F.regexp_replace(F.regexp_replace(path, r"(?:\.d)*(?:\.[^./]*)?\z", ""), r"/index\z", "")


def _stems(base: Column) -> Column:
    """The stems of all that _tries gives for a base, three at most."""
    return F.array_distinct(F.array(_stem(base), F.regexp_replace(F.regexp_replace(base, r"(?:\.d)+\z", ""), r"/index\z", ""), base))


def script_targets(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases=(), base_url: str | None = None, options: DataFrame | None = None) -> DataFrame:
    """(file, line, spec, kind, target) with kind `file`, `external` or `unknown`.

    aliases are (pattern, [targets]) of the compiler options: an exact pattern wins, then the longest start; packages
    (name, dir, entry) are those of the workspace, entry the file that the bare name means (null: the directory).
    options (dir, base_url, aliases) differ by directory, the nearest one above a file holds for it (config.inherited gives
    them).  Maps of exports are not read."""
    imports = cut(imports, "script-imports")  # read twice
    spec = F.substring_index("spec", "?", 1)
    order = sorted(range(len(aliases)), key=lambda i: ("*" in aliases[i][0], -len(aliases[i][0].split("*")[0]), i))
    pattern, targets = F.when(F.lit(False), ""), F.when(F.lit(False), F.array(F.lit("")))
    for p, into in (aliases[i] for i in order):
        start, star, end = p.partition("*")
        fits = (spec == p) if not star else (spec.startswith(start) & spec.endswith(end) & (F.length(spec) >= len(start) + len(end)))
        inner = F.substring(spec, F.lit(len(start) + 1), F.length(spec) - len(start) - len(end))
        pattern = pattern.when(fits, p)
        targets = targets.when(fits, F.array(*(normal(F.replace(F.lit(t), F.lit("*"), inner)) for t in into)))
    near = spec.rlike(r"^\.")
    bare = ~near & ~spec.rlike("^(?:/|node:|#)")
    rows = imports.select("spec", directory(F.col("file")).alias("dir")).distinct()
    rows = rows.withColumn("near", near).withColumn("bare", bare).withColumn("pattern", F.when(bare, pattern)).withColumn("targets", F.when(bare, targets))
    based = F.lit(base_url)
    if options is not None:
        from .config import alias_of, nearest_options

        rows = rows.join(nearest_options(rows.select("dir").distinct(), options), "dir").withColumn("_alias", F.when(F.col("bare"), alias_of(spec, F.col("aliases"))))
        rows = rows.withColumns({"pattern": F.coalesce("_alias.pattern", "pattern"), "targets": F.coalesce("_alias.into", "targets")}).drop("_alias", "aliases")
        based = F.coalesce(F.col("base_url"), based)
    name = F.regexp_extract(spec, r"^(@[^/]*/[^/]+|[^/]+)", 1)
    if packages is not None:
        own = packages.select(F.col("name").alias("_name"), F.col("dir").alias("_dir"), F.col("entry").alias("_entry")).dropDuplicates(["_name"])
        rows = rows.join(own, F.col("bare") & (name == F.col("_name")), "left")
    else:
        rows = rows.select("*", *(F.lit(None).cast("string").alias(x) for x in ("_name", "_dir", "_entry")))
    none = F.array().cast("array<string>")
    near_base = F.when(F.col("near"), normal(F.concat("dir", F.lit("/"), spec)))
    rooted = F.when(F.col("bare") & F.col("pattern").isNull(), normal(F.concat(based, F.lit("/"), spec))) if base_url is not None or options is not None else F.lit(None).cast("string")
    below = F.expr("substring(substring_index(spec, '?', 1), length(_name) + 1)")
    inside = F.concat("_dir", F.when((below == "") & F.col("_entry").isNotNull(), F.concat(F.lit("/"), "_entry")).otherwise(below))
    package = F.when(F.col("_name").isNotNull(), normal(inside))
    # a base has some 28 tries but three stems at most: files meet bases by stem, and only what meets is tried
    def base(path: Column, exact: bool = False) -> Column:
        return F.when(path.isNotNull(), F.struct(path.alias("base"), F.lit(exact).alias("exact")))

    targets = F.transform(F.coalesce("targets", none), lambda t: base(t, True))
    bases = F.array_compact(F.concat(F.array(base(near_base)), targets, F.array(base(rooted), base(package))))
    asked = rows.select("spec", "dir", F.posexplode(bases).alias("nth", "b")).select("spec", "dir", "nth", "b.base", "b.exact")
    tried = asked.withColumn("stem", F.explode(_stems(F.col("base"))))
    there = files.select("file").distinct().where(~F.col("file").rlike("(?:^|/)node_modules(?:/|$)")).withColumn("stem", _stem(F.col("file")))
    at = F.when(F.col("exact") & (F.col("file") == F.col("base")), 1).otherwise(F.array_position(_tries(F.col("base")), F.col("file")))
    found = tried.join(there, "stem").withColumn("at", at).where("at > 0").groupBy("spec", "dir").agg(F.min_by("file", F.struct("nth", (~F.col("exact") | (F.col("file") != F.col("base"))).alias("after"), "at")).alias("target"))
    rows = rows.join(found, ["spec", "dir"], "left")
    installed = F.coalesce(normal(F.concat("dir", F.lit("/"), spec)).rlike("(?:^|/)node_modules(?:/|$)"), F.lit(False))
    kind = (
        F.when(F.col("target").isNotNull(), "file").when(F.col("near"), F.when(installed, "external").otherwise("unknown"))
        .when(spec.rlike("^node:"), "external").when(~F.col("bare"), "unknown")
        .when(F.exists(F.coalesce("targets", none), lambda t: t.rlike("(?:^|/)node_modules(?:/|$)")), "external")
        .when(F.col("_name").isNotNull() | (F.col("pattern") != "*"), "unknown").otherwise("external")
    )
    known = rows.select("spec", "dir", kind.alias("kind"), "target")
    return imports.withColumn("dir", directory(F.col("file"))).join(known, ["spec", "dir"]).select("file", "line", "spec", "kind", "target")
