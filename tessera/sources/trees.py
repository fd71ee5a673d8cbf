"""Comparison of two trees by the digests of their directories.

A tree is a table of (dir, name, is_dir, digest): entries of each directory, where
the digest of a directory is that of its entries.  Comparison starts at the root
and goes down a level a round, only into directories whose digests differ, so what
is read of the lower levels grows with the change and not with the tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import directory
from ..operators.uses import ancestors
from .scratch import cut

ENTRY = ["dir", "name", "is_dir", "digest"]


def _above(path: Column) -> Column:
    return F.when(path.contains("/"), directory(path)).otherwise("")


def tree(files: DataFrame) -> DataFrame:
    """Entries of a tree from (file, digest), written; directories get the digest of their sorted entries, deepest first.

    A directory's digest needs those below it, so there is a round a level.  A file
    given twice counts once, by its least digest.
    """
    own = files.groupBy("file").agg(F.min(F.coalesce("digest", F.lit(""))).alias("digest"))
    level = F.size(F.split("file", "/"))
    leaves = cut(own.select(_above(F.col("file")).alias("dir"), F.regexp_extract("file", "([^/]*)$", 1).alias("name"), F.lit(False).alias("is_dir"), "digest", level.alias("level")), "leaves")
    deepest = leaves.agg(F.max("level")).first()[0] or 0
    below = leaves.where(f"level = {deepest}").select(*ENTRY)
    done = [below]
    for depth in range(deepest - 1, 0, -1):
        sums = below.groupBy("dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x00", "name", F.col("is_dir").cast("string"), "digest"))), "\x01"), 256).alias("digest"))
        dirs = sums.select(_above(F.col("dir")).alias("dir"), F.regexp_extract("dir", "([^/]*)$", 1).alias("name"), F.lit(True).alias("is_dir"), "digest")
        below = cut(dirs.unionByName(leaves.where(f"level = {depth}").select(*ENTRY)), "entries")
        done.append(below)
    return reduce(DataFrame.unionByName, done)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change, old_file) of files that differ: added, changed, removed, renamed; before and after are entries, written.

    A file that goes and one that comes with the same digest are a rename where both
    are the only ones, paired by order where there are as many of each.
    """
    open_ = before.sparkSession.createDataFrame([("",)], "dir string")
    found: list[DataFrame] = []
    while True:
        b = before.join(open_, "dir", "left_semi").select("dir", "name", F.col("is_dir").alias("b_dir"), F.col("digest").alias("b"))
        a = after.join(open_, "dir", "left_semi").select("dir", "name", F.col("is_dir").alias("a_dir"), F.col("digest").alias("a"))
        differ = cut(b.join(a, ["dir", "name"], "full").where("NOT (b <=> a AND b_dir <=> a_dir)"), "differ")
        found.append(differ)
        path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
        open_ = cut(differ.where("coalesce(a_dir, false) OR coalesce(b_dir, false)").select(path.alias("dir")), "open")
        if open_.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    every = every.select(path.alias("file"), F.when(~F.col("b_dir"), F.col("b")).alias("b"), F.when(~F.col("a_dir"), F.col("a")).alias("a")).where("a IS NOT NULL OR b IS NOT NULL")
    every = cut(every, "files")
    def numbered(side: str, other: str, name: str) -> DataFrame:
        gone = every.where(f"{side} IS NOT NULL AND {other} IS NULL").select(F.col(side).alias("digest"), F.col("file").alias(name))
        w = Window.partitionBy("digest")
        return gone.select("digest", name, F.row_number().over(w.orderBy(name)).alias("nth"), F.count("*").over(w).alias("n"))

    moved = numbered("b", "a", "old_file").join(numbered("a", "b", "file"), ["digest", "nth", "n"]).select("file", "old_file")
    moved = cut(moved, "renamed")
    plain = every.join(moved.select("file"), "file", "left_anti").join(moved.select(F.col("old_file").alias("file")), "file", "left_anti")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return plain.select("file", change.alias("change"), F.lit(None).cast("string").alias("old_file")).unionByName(moved.select("file", F.lit("renamed").alias("change"), "old_file"))


def below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files that lie at or below one of roots (dir)."""
    up = files.select("file").distinct().select("file", F.explode(ancestors(F.col("file"))).alias("dir"))
    return files.join(up.join(roots.select("dir").distinct(), "dir", "left_semi").select("file").distinct(), "file", "left_semi")
