"""What a run looks at: exclusions, the subtree, languages, and the module of a file by path or by node key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..sources.code import language
from .uses import module_of

#: Directories of tools, caches and dependencies.
EXCLUDED = [f"**/{d}/**" for d in ("reports", ".venv", "node_modules", "vendor", "pkg/mod", "dist", "build", "testdata")]


def exclusions(configured: list[str], default: list[str] = EXCLUDED) -> list[str]:
    """Defaults and configured globs, each once and in order; `!name` takes a default back."""
    kept = set(default)
    for glob in configured:
        if glob.startswith("!"):
            kept -= {glob[1:], f"**/{glob[1:]}/**", f"**/{glob[1:]}"}
        else:
            kept.add(glob)
    return sorted(kept)


def out_of_scope(file: Column, globs: list[str], disabled: list[str] = ()) -> Column:
    """A file that a glob excludes or whose language is switched off."""
    off = language(file).isin(list(disabled)) if disabled else F.lit(False)
    return reduce(lambda c, g: c | file.rlike(glob_regex(g)), globs, off)


def rebased(files: DataFrame, prefix: str) -> DataFrame:
    """files below a directory, named from there; all of them at the root."""
    if not prefix:
        return files
    return files.where(F.col("file").startswith(prefix + "/")).withColumn("file", F.substring("file", F.lit(len(prefix) + 2), F.length("file")))


def node_key(file: Column) -> Column:
    """The key of a file's node: the dotted module of a Python file, the directory of a Go file, else the file."""
    py = F.regexp_replace(F.replace(F.regexp_replace(file, r"(?:/__init__)?\.py$", ""), F.lit("/"), F.lit(".")), r"^\.", "")
    lang = language(file)
    return F.when(lang == "python", py).when(lang == "go", F.regexp_replace(file, "/?[^/]*$", "")).otherwise(file)


def module_of_file(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, module): by the path; where no glob matches it, by the key of its node."""
    first = module_of(files, paths)
    rest = first.where("module IS NULL").select("file", node_key(F.col("file")).alias("key")).where("key <> '' AND key <> file")
    second = rest.join(module_of(rest.select(F.col("key").alias("file")), paths).select(F.col("file").alias("key"), F.col("module").alias("by_key")), "key").select("file", "by_key")
    return first.join(second, "file", "left").select("file", F.coalesce("module", "by_key").alias("module"))


def edges_at(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, side, ...): the edges that leave (`from`) and reach (`to`) each node asked for."""
    asked = nodes.select("node").distinct()
    out = edges.join(asked, F.col("from") == F.col("node")).withColumn("side", F.lit("from"))
    return out.unionByName(edges.join(asked, F.col("to") == F.col("node")).withColumn("side", F.lit("to")))
