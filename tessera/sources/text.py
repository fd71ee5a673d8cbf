"""Facts from raw text: literals, unified diffs, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns.
QUOTED = r"\"([^\"\n]*)\""
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, line, content), lines from 1."""
    return files.select("file", F.posexplode(F.split(text, "\n")).alias("at", "content")).select("file", (F.col("at") + 1).alias("line"), "content")


def literals(files: DataFrame, text: str = "text") -> DataFrame:
    found = lines(files, text)
    return found.select("file", "line", F.explode(F.regexp_extract_all("content", F.lit(QUOTED), F.lit(1))).alias("value"))


def added_lines(diffs: DataFrame, text: str = "text") -> DataFrame:
    """(file, line) of lines that a unified diff adds; hunks are counted, so a line like a header is content."""
    w = Window.partitionBy("file").orderBy("line")
    rows = lines(diffs, text).withColumn("head", F.regexp_extract("content", HUNK, 1))
    rows = rows.withColumn("hunk", F.sum(F.when(F.col("head") != "", 1).otherwise(0)).over(w)).where("hunk > 0")
    inside = Window.partitionBy("file", "hunk").orderBy("line")
    start = F.max(F.when(F.col("head") != "", F.col("head").cast("long"))).over(Window.partitionBy("file", "hunk"))
    counted = F.when(F.col("head") == "", F.when(F.substring("content", 1, 1).isin("+", " "), 1).otherwise(0)).otherwise(0)
    rows = rows.withColumn("place", start + F.sum(counted).over(inside) - 1)
    return rows.where("head = '' AND startswith(content, '+')").select("file", F.col("place").alias("line"))


def carried(rows: DataFrame, at: str, value: str, block: int = 4096) -> DataFrame:
    """rows with the last value at or before each place.  Blocks of places carry on their own; one row a block carries between them."""
    rows = rows.withColumn("_block", F.expr(f"{at} div {block}"))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col(value).isNotNull()).groupBy("_block").agg(F.max_by(value, at).alias("_end"))
    ends = rows.select("_block").distinct().join(ends, "_block", "left")
    before = ends.select("_block", F.last("_end", True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return rows.withColumn("_own", F.last(value, True).over(inside)).join(before, "_block").select(at, F.coalesce("_own", "_before").alias(value))


def sanitized(text: Column, most: int = 200) -> Column:
    """Text without terminal escapes and control characters, at most so many code points."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", ""), r"[\x00-\x1f\x7f]+", " ")
    return F.substring(plain, 1, most)
