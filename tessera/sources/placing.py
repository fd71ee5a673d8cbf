"""Coverage facts placed on the files of a tree, reconciled, and rolled up by module.

A reported path is tried as what it may mean, in order: below the root where it is
absolute, below each module whose path it starts with (longest first), below the
scanned directory's own prefix, and as it stands; the first that is a file of the
tree holds.  Tries are rows, so placing is one equi-join.  What names no file of the
tree, or leaves the root, is unresolved and counted by report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.uses import ancestors
from .imports import normal
from .scratch import cut


def cleaned(raw: Column) -> Column:
    """A reported path with forward slashes and without a leading ./; null where it is blank or of another drive."""
    text = F.regexp_replace(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when((text != "") & ~text.rlike(r"^[A-Za-z]:") & ~text.contains("\x00"), text)


def placed(facts: DataFrame, files: DataFrame, modules: DataFrame, root: str = "/", prefix: str = "") -> DataFrame:
    """facts with path, the file of the tree that each names (null: unresolved).

    facts: file and more; files: file; modules: (path, dir) of the tree's module
    files; root: where the tree lies; prefix: the scanned directory below its module.
    """
    facts = cut(facts, "coverage-facts")  # read twice
    raw = facts.select("file").distinct().withColumn("clean", cleaned(F.col("file")))
    at = root.rstrip("/") + "/"
    absolute = F.col("clean").startswith("/")
    lead = raw.where(~absolute).select("file", "clean", F.explode(ancestors(F.col("clean"))).alias("path")).where("path <> ''")
    inside = lead.join(modules.select("path", "dir"), "path")
    rest = F.expr("substring(clean, length(path) + 2)")
    by_module = inside.select("file", (-F.length("path")).alias("order"), normal(F.concat_ws("/", "dir", rest)).alias("path"))
    last = F.lit(1 << 30)
    plain = raw.where(~absolute).select("file", last.alias("order"), normal(F.col("clean")).alias("path"))
    whole = normal(F.col("clean"))
    own = F.lit(normal_text(at))
    below = raw.where(absolute).select("file", F.lit(0).alias("order"), F.when(own == "", whole).when(F.startswith(whole, F.concat(own, F.lit("/"))), F.substring(whole, F.length(own) + 2, F.length(whole))).alias("path"))
    tries = by_module.unionByName(plain).unionByName(below)
    if prefix:
        stem = normal_text(prefix)
        tries = tries.unionByName(raw.where(F.startswith("clean", F.lit(stem + "/"))).select("file", (last - 1).alias("order"), normal(F.expr(f"substring(clean, {len(stem) + 2})")).alias("path")))
    hit = tries.where("path IS NOT NULL").join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("file").agg(F.min_by("path", "order").alias("path"))
    return facts.join(hit, "file", "left")


def normal_text(path: str) -> str:
    return "/".join(x for x in path.split("/") if x not in ("", "."))


def unresolved(placed: DataFrame) -> DataFrame:
    """(report, named, unresolved): files that each report names, and how many of them the tree lacks."""
    each = placed.select("report", "file", F.col("path").isNull().alias("lost")).distinct()
    return each.groupBy("report").agg(F.count("file").alias("named"), F.count(F.when(F.col("lost"), F.col("file"))).alias("unresolved"))


def reconciled(placed: DataFrame) -> DataFrame:
    """(path, unit, covered, total, reports, incompatible) of each file: the most that a report covers, where all count the same total; else nothing is added up."""
    by = placed.where("path IS NOT NULL").groupBy("path", "unit").agg(F.max("covered").alias("covered"), F.min("total").alias("least"), F.max("total").alias("total"), F.count_distinct("report").alias("reports"))
    bad = F.col("least") != F.col("total")
    return by.select("path", "unit", F.when(~bad, F.col("covered")).alias("covered"), F.when(~bad, F.col("total")).alias("total"), "reports", bad.alias("incompatible"))


def rolled_up(files: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(module, unit, files, measured, incompatible, covered, total, share) of production files; files: file, module, class.

    A module without a measured file has one row with a null unit.
    """
    own = files.where((F.col("class") == "production") & F.col("module").isNotNull())
    size = own.groupBy("module").agg(F.count_distinct("file").alias("files"))
    by = own.join(reconciled, own["file"] == reconciled["path"]).groupBy("module", "unit").agg(F.count("*").alias("measured"), F.count_if("incompatible").alias("incompatible"), F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    out = size.join(by, "module", "left").fillna(0, ["measured", "incompatible"])
    share = F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 6))
    return out.select("module", "unit", "files", "measured", "incompatible", "covered", "total", share.alias("share"))
