"""Configuration that files inherit: compiler options over ``extends``, members of Go workspaces.

An option comes from the nearest file that sets it: a file's own before those it
extends, and of several that it extends, the last one listed before the others.
The files that one inherits from are found by doubling: each round joins the known
steps with themselves, so a chain of n files takes log n rounds.  Files on a circle
are found first, reported, and inherit nothing from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import directory
from ..operators.graph import strong_components
from ..operators.uses import ancestors
from .imports import normal
from .scratch import cut

_STRING = r'("(?:[^"\\]++|\\[\s\S])*+")'
ALIASES = "array<struct<pattern: string, into: array<string>, at: int>>"


def plain_json(text: Column) -> Column:
    """JSON with comments and closing commas as plain JSON; what stands in strings stays."""
    bare = F.regexp_replace(text, _STRING + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, _STRING + r"|,(?=\s*[}\]])", "$1")


def compiler_options(files: DataFrame) -> DataFrame:
    """(file, extends, base_url, aliases, readable) of the compiler's configuration files; paths are from the root of the tree.

    files: file, text.  Targets of aliases stand from the base directory, or from the file that sets them.
    """
    js = plain_json(F.coalesce("text", F.lit("")))
    got = F.from_json(js, "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    raw = F.get_json_object(js, "$.extends")
    many = F.from_json(raw, "array<string>")
    one = F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), many).otherwise(F.array(raw))
    rows = files.withColumns({"_o": got, "_e": one, "_dir": F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise("")})
    base = F.when(F.col("_o.compilerOptions.baseUrl").isNotNull(), normal(F.concat("_dir", F.lit("/"), F.col("_o.compilerOptions.baseUrl"))))
    root = F.coalesce(base, F.col("_dir"))
    entries = F.map_entries("_o.compilerOptions.paths")
    aliases = F.transform(entries, lambda e, i: F.struct(e["key"].alias("pattern"), F.transform(e["value"], lambda t: normal(F.concat(root, F.lit("/"), t))).alias("into"), i.cast("int").alias("at")))
    ok = F.coalesce(F.get_json_object(js, "$").isNotNull(), F.lit(False))
    return rows.select("file", F.col("_e").alias("extends"), base.alias("base_url"), aliases.cast(ALIASES).alias("aliases"), ok.alias("readable"))


def _parents(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, parent, rank) with the later one listed before the earlier one, and (file, extends) of those that name no file."""
    asked = configs.select("file", F.size("extends").alias("n"), F.posexplode("extends").alias("at", "extends"))
    here = F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise("")
    near = F.col("extends").rlike(r"^\.{1,2}(?:/|$)")
    at = normal(F.concat(here, F.lit("/"), "extends"))
    local = F.array(at, F.concat(at, F.lit(".json")), F.concat(at, F.lit("/tsconfig.json")))
    up = F.reverse(ancestors(here))
    package = F.flatten(F.transform(up, lambda d: F.transform(F.array(F.lit(""), F.lit(".json"), F.lit("/tsconfig.json")), lambda end: normal(F.concat(d, F.lit("/node_modules/"), F.col("extends"), end)))))
    tried = asked.select("file", "extends", (F.col("n") - F.col("at") - 1).alias("rank"), F.posexplode(F.when(near, local).otherwise(package)).alias("try", "parent"))
    found = tried.join(configs.select(F.col("file").alias("parent")), "parent").groupBy("file", "extends", "rank").agg(F.min_by("parent", "try").alias("parent"))
    lost = asked.select("file", "extends").join(found, ["file", "extends"], "left_anti").distinct()
    return found.select("file", "parent", F.array("rank").alias("rank")), lost


def inherited(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, dir, base_url, aliases) with what each file inherits, and problems (file, problem); configs: as compiler_options."""
    configs = cut(configs, "configs")
    steps, lost = _parents(configs)
    steps = cut(steps, "extends")
    ring = strong_components(steps.select(F.col("file").alias("a"), F.col("parent").alias("b"))).select(F.col("node").alias("file"), "component")
    ring = cut(ring.unionByName(steps.where("file = parent").select("file", F.col("file").alias("component"))).distinct(), "rings")
    inside = steps.join(ring.withColumnRenamed("component", "c"), "file").join(ring.select(F.col("file").alias("parent"), F.col("component").alias("c")), ["parent", "c"]).select("file", "parent")
    known = cut(steps.join(inside, ["file", "parent"], "left_anti"), "ancestors")
    n = known.count()
    while True:
        further = known.select("file", F.col("parent").alias("via"), F.col("rank").alias("first")).join(known.select(F.col("file").alias("via"), "parent", F.col("rank").alias("then")), "via").select("file", "parent", F.concat("first", "then").alias("rank"))
        known = cut(known.unionByName(further).groupBy("file", "parent").agg(F.min("rank").alias("rank")), "ancestors")
        was, n = n, known.count()
        if n == was:
            break
    own = configs.select("file", F.col("file").alias("parent"), F.array().cast("array<int>").alias("rank"))
    values = own.unionByName(known).join(configs.select(F.col("file").alias("parent"), "base_url", "aliases"), "parent")
    nearest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in ("base_url", "aliases")]
    by = values.groupBy("file").agg(*nearest)
    problems = reduce(DataFrame.unionByName, [
        configs.where("NOT readable").select("file", F.lit("cannot be read").alias("problem")), ring.select("file", F.lit("extends itself in a circle").alias("problem")),
        lost.select("file", F.concat(F.lit("extends no file: "), "extends").alias("problem")),
    ])
    return by.select("file", F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise("").alias("dir"), "base_url", "aliases"), problems


def nearest_options(dirs: DataFrame, options: DataFrame) -> DataFrame:
    """dirs(dir) with base_url and aliases of the nearest directory above that has options."""
    at = F.when(F.col("dir") == ".", "").otherwise(F.col("dir"))
    up = dirs.select("dir").distinct().select("dir", F.explode(ancestors(at)).alias("above"))
    hit = up.join(options.select(F.col("dir").alias("above"), "base_url", "aliases"), "above")
    return dirs.join(hit.groupBy("dir").agg(F.max_by(F.struct("base_url", "aliases"), F.length("above")).alias("o")).select("dir", "o.base_url", "o.aliases"), "dir", "left")


def alias_of(spec: Column, aliases: Column) -> Column:
    """(pattern, into) of the alias that a specifier meets: an exact pattern wins, then the longest start, then the first; the star's part filled in."""
    def fits(a: Column) -> Column:
        start, end = F.substring_index(a["pattern"], "*", 1), F.substring_index(a["pattern"], "*", -1)
        return F.when(~F.contains(a["pattern"], F.lit("*")), spec == a["pattern"]).otherwise(F.startswith(spec, start) & F.endswith(spec, end) & (F.length(spec) >= F.length(start) + F.length(end)))

    def ranked(a: Column) -> Column:
        start, end = F.substring_index(a["pattern"], "*", 1), F.substring_index(a["pattern"], "*", -1)
        inner = F.substring(spec, F.length(start) + 1, F.length(spec) - F.length(start) - F.length(end))
        into = F.when(F.contains(a["pattern"], F.lit("*")), F.transform(a["into"], lambda t: F.replace(t, F.lit("*"), inner))).otherwise(a["into"])
        return F.struct(F.contains(a["pattern"], F.lit("*")).alias("star"), (-F.length(start)).alias("long"), a["at"].alias("at"), a["pattern"].alias("pattern"), into.alias("into"))

    return F.array_min(F.transform(F.filter(aliases, fits), ranked))


def go_members(files: DataFrame) -> DataFrame:
    """(work, dir) of the members that go.work files list; files: file, text.  Comments go, blocks and single lines count."""
    work = files.where(F.col("file").rlike(r"(?:^|/)go\.work$"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"//[^\n]*", "")
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*use[ \t]*\(([^)]*)\)"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*use[ \t]+([^\s(]+)"), F.lit(1))
    named = F.concat(single, F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(\S+)"), F.lit(1)))))
    here = F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise("")
    return work.select(F.col("file").alias("work"), F.explode(F.transform(named, lambda m: normal(F.concat(here, F.lit("/"), F.regexp_replace(m, '^["`]|["`]$', ""))))).alias("dir")).where("dir IS NOT NULL").distinct()


def member_of(files: DataFrame, members: DataFrame) -> DataFrame:
    """(file, member): the nearest enclosing member's directory; null outside all of them."""
    here = F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise("")
    up = files.select("file").distinct().select("file", F.explode(ancestors(here)).alias("dir"))
    hit = up.join(members.select("dir").distinct(), "dir").groupBy("file").agg(F.max_by("dir", F.length("dir")).alias("member"))
    return files.select("file").distinct().join(hit, "file", "left")
