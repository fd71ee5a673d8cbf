"""Files, modules and the uses between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import directory
from ..functions.globs import glob_regex, literal_root, specificity

PATHS = "module string, glob string, regex string, root string, spec int"
#: Rows of a policy table that are sent to every task at most; a larger one is joined by its key.
POLICY_ROWS = 10_000


def policy_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a policy as a table, broadcast where they are few enough."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= POLICY_ROWS else out


def paths_table(spark: SparkSession, globs: list[tuple[str, str]]) -> DataFrame:
    """Compiled (module, glob) pairs of a policy."""
    return policy_table(spark, [(m, g, glob_regex(g), literal_root(g), specificity(g)) for m, g in globs], PATHS)


def ancestors(path: Column) -> Column:
    """'' and every leading part of a path on whole segments, itself included."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def glob_matches(files: DataFrame, paths: DataFrame) -> DataFrame:
    """files x matching globs: joined by the directory that a glob names literally, the regex on what is left."""
    return files.withColumn("root", F.explode(ancestors(F.col("file")))).join(paths, "root").where("file RLIKE regex").drop("root")


def module_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, module): the most specific glob wins, then the first name; null where none matches."""
    own = files.select("file").distinct()
    best = glob_matches(own, paths).groupBy("file").agg(F.min(F.struct((-F.col("spec")).alias("s"), "module")).alias("m"))
    return own.join(best, "file", "left").select("file", F.col("m.module").alias("module"))


def ownership_ties(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(module_a, module_b, first_file, files) for files whose best globs are of two modules."""
    hit = glob_matches(files.select("file").distinct(), paths)
    top = hit.withColumn("r", F.rank().over(Window.partitionBy("file").orderBy(F.desc("spec")))).where("r = 1").select("file", "module").distinct()
    both = top.alias("a").join(top.alias("b"), F.expr("a.file = b.file AND a.module < b.module"))
    return both.groupBy(F.col("a.module").alias("module_a"), F.col("b.module").alias("module_b")).agg(F.min("a.file").alias("first_file"), F.count("*").alias("files"))


def dead_globs(files: DataFrame, paths: DataFrame) -> DataFrame:
    live = glob_matches(files.select("file").distinct(), paths).select("module", "glob").distinct()
    return paths.select("module", "glob").join(live, ["module", "glob"], "left_anti")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the longest prefix on whole segments, by equi-join on the ancestors of a path."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("prefix")).where("prefix <> ''")
    hit = up.join(prefixes.select("prefix"), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.join(hit, "path", "left")


def dir_ends(files: DataFrame) -> DataFrame:
    """(dir, module, files) from (file, module, production): production files decide, others only where there are none."""
    by = files.groupBy(directory(F.col("file")).alias("dir")).agg(F.count_if("production").alias("n"), F.collect_set(F.when(F.col("production"), F.col("module"))).alias("p"), F.collect_set("module").alias("q"), F.count("*").alias("files"))
    agreed = F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("q"))
    return by.select("dir", F.when(F.size(agreed) == 1, F.element_at(agreed, 1)).alias("module"), "files")


def public_use(uses: DataFrame, public: DataFrame) -> DataFrame:
    """uses with public: the target, or its directory, matches a public glob of its module; all of a module without such globs is public."""
    target = uses.select("target", "to_module").distinct()
    declared = public.select(F.col("module").alias("to_module")).distinct().withColumn("declared", F.lit(True))
    p = public.select(F.col("module").alias("m"), "regex")
    on = (F.col("to_module") == F.col("m")) & F.expr("target RLIKE regex OR regexp_replace(target, '/[^/]*$', '') RLIKE regex")
    hit = target.join(p, on, "left_semi").withColumn("hit", F.lit(True))
    known = target.join(declared, "to_module", "left").join(hit, ["target", "to_module"], "left")
    return uses.join(known.select("target", "to_module", (F.col("declared").isNull() | F.col("hit").isNotNull()).alias("is_public")), ["target", "to_module"])


def named(modules: DataFrame, denied: DataFrame) -> DataFrame:
    """(module, deny_from, deny_to): the deny rules, as (pos, id), whose patterns name each module.  The rules travel as one row."""
    every = denied.agg(F.collect_list(F.struct("pos", "id", "from_regex", "to_regex")).alias("rules"))

    def of(side: str) -> Column:
        hit = F.filter("rules", lambda r: F.rlike(F.col("module"), r[side]))
        return F.transform(hit, lambda r: F.struct(r["pos"].alias("pos"), r["id"].alias("id")))

    return modules.select("module").distinct().crossJoin(F.broadcast(every)).select("module", of("from_regex").alias("deny_from"), of("to_regex").alias("deny_to"))
