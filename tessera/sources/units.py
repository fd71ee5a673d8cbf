"""Deploy units that checked-in files show, by directory and by module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import directory
from .code import language

#: Sources of a unit, the first that shows a directory wins.
SOURCES = ["go_main", "workspace", "pyproject", "dockerfile", "k8s"]


def _base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def _shown(name: Column, else_: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), else_)


def _workspaces(files: DataFrame, root: str) -> DataFrame:
    manifests = files.where(_base(F.col("file")) == "package.json").select(directory(F.col("file")).alias("dir"), F.try_parse_json("text").alias("j")).where("j IS NOT NULL")
    name = F.try_variant_get("j", "$.name", "string")
    top = manifests.where("dir = '.'")
    main = F.coalesce(F.try_variant_get("j", "$.main", "string"), F.lit("")) != ""
    bin_ = F.coalesce(F.schema_of_variant(F.try_variant_get("j", "$.bin", "variant")), F.lit("VOID")) != "VOID"
    own = top.where(main | bin_).select("dir", _shown(name, F.lit(root)).alias("unit"))
    listed = F.coalesce(F.try_variant_get("j", "$.workspaces", "array<string>"), F.try_variant_get("j", "$.workspaces.packages", "array<string>"))
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("g", "^[.]/|/$", ""), r"([.+()|^$\{\}])", r"\\$1"), r"\*+", "[^/]*"), r"\?", "[^/]")
    globs = top.select(F.explode(listed).alias("g")).select(F.concat(F.lit("^"), glob, F.lit("$")).alias("regex"))
    found = manifests.where("dir <> '.'").join(globs, F.expr("dir RLIKE regex"), "left_semi")
    return own.unionByName(found.select("dir", _shown(name, _base(F.col("dir"))).alias("unit")))


def _pyproject(files: DataFrame) -> DataFrame:
    said = F.regexp_extract("text", r"(?ms)^[ \t]*\[project\][ \t\r]*$(?:(?!^[ \t]*\[).)*?^[ \t]*name[ \t]*=[ \t]*([^\n]*)", 1)
    d = directory(F.col("file"))
    return files.where(_base(F.col("file")) == "pyproject.toml").select(d.alias("dir"), _shown(F.regexp_replace(F.trim(F.regexp_replace(said, "\r", "")), "^[\"']+|[\"']+$", ""), _base(d)).alias("unit"))


def _k8s(files: DataFrame, root: str) -> DataFrame:
    docs = F.split("text", "\n---")
    deploys = F.filter(docs, lambda x: x.rlike(r"(?m)^kind[ \t]*:[ \t]*(?:Deployment|StatefulSet)[ \t\r]*$"))
    block = F.regexp_extract(F.get(deploys, F.lit(0)), r"(?m)^metadata[ \t]*:[^\n]*\n((?:[ \t][^\n]*\n?|#[^\n]*\n?|\r?\n)*)", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+name[ \t]*:[ \t]*([^\r\n]*)"), F.lit(1))
    d = directory(F.col("file"))
    rows = files.where(F.lower(F.col("file")).rlike(r"\.ya?ml$")).where(F.size(deploys) > 0)
    return rows.select(d.alias("dir"), _shown(F.get(names, F.size(names) - 1), F.when(d == ".", root).otherwise(_base(d))).alias("unit"), "file")


def units(files: DataFrame, owners: DataFrame, root: str = "root") -> DataFrame:
    """(dir, unit, source) of files (file, text); the earlier source wins, then the earlier file.

    owners (dir, module, is_root): a Go program inside a module counts at the module's root alone, and has its name.  Null
    texts show nothing but a Dockerfile."""
    d = directory(F.col("file"))
    go = files.where((language(F.col("file")) == "go") & ~F.col("file").endswith("_test.go") & F.col("text").rlike(r"(?m)^package[ \t]+main\b")).select(d.alias("dir")).distinct()
    go = go.where("dir <> '.'").join(owners, "dir", "left").where("module IS NULL OR is_root").select("dir", F.coalesce("module", _base(F.col("dir"))).alias("unit"))
    walked = files.where(~F.col("file").rlike(r"(?:^|/)(?:\.[^/]+|node_modules|vendor)/"))
    docker = walked.where(_base(F.col("file")).rlike(r"^Dockerfile(?:\..*)?$")).select(d.alias("dir"), F.when(d == ".", root).otherwise(_base(d)).alias("unit"))
    first = _k8s(walked, root).groupBy("dir").agg(F.min_by("unit", "file").alias("unit"))
    parts = [go, _workspaces(files, root), _pyproject(walked), docker.distinct(), first]
    rows = reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(s)).withColumn("at", F.lit(k)) for k, (s, p) in enumerate(zip(SOURCES, parts, strict=True))])
    best = rows.where("unit <> ''").groupBy("dir").agg(F.min(F.struct("at", "unit", "source")).alias("b"))
    return best.select("dir", "b.unit", "b.source")


def by_module(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(module, unit, source, dir): the first directory of a module decides."""
    return found.join(owners.where("module IS NOT NULL").select("dir", "module"), "dir").groupBy("module").agg(F.min(F.struct("dir", "unit", "source")).alias("b")).select("module", "b.unit", "b.source", "b.dir")
