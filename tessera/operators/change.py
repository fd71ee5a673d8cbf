"""What a change adds: base against head, exceptions, unknown items, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["rule", "from", "to"]


def added(base: DataFrame, head: DataFrame, lines: DataFrame) -> DataFrame:
    """Keys of head with more distinct sites than on base: (key, base_sites, head_sites, added_sites); unowned also needs an added line."""
    def count(e, name):
        return e.select(*KEY, "file", "line").distinct().groupBy(*KEY).agg(F.count("*").alias(name))

    on = head.select(*KEY, "file", "line").distinct().join(lines.withColumn("new", F.lit(1)), ["file", "line"], "left").groupBy(*KEY).agg(F.count("*").alias("head_sites"), F.count("new").alias("added_sites"))
    return more(on.join(count(base, "base_sites"), KEY, "left").fillna(0, ["base_sites"]))


def more(keys: DataFrame) -> DataFrame:
    """Keys, counted on both sides, of which head has more."""
    found = keys.where("head_sites > base_sites AND (rule <> 'unowned' OR added_sites > 0) AND (rule <> 'duplication' OR added_sites > 0)")
    return found.select(*KEY, "base_sites", "head_sites", "added_sites")


def covered(errors: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """errors with covered: an exception of their rule that holds today names them, by its rule's form."""
    e = exceptions.where(F.col("expires").isNull() | (F.col("expires") >= F.to_date(F.lit(today))))
    hit = errors.alias("e").join(e.alias("x"), _named(), "left_semi").select(*[F.col(f"e.{c}") for c in KEY]).distinct().withColumn("covered", F.lit(True))
    return errors.join(hit, KEY, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _named():
    return F.expr("""e.rule = x.rule AND CASE
      WHEN x.rule = 'unowned' THEN e.`from` RLIKE x.from_regex
      WHEN x.rule IN ('duplication', 'cycle') THEN least(e.`from`, e.`to`) = least(x.`from`, x.`to`) AND greatest(e.`from`, e.`to`) = greatest(x.`from`, x.`to`)
      WHEN x.`to` IS NULL THEN e.`from` = x.`from`
      ELSE e.`from` = x.`from` AND e.`to` = x.`to` END""")


def expired_errors(errors: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Exceptions past their last day whose code is still broken: (rule, from, to, expires, errors)."""
    gone = exceptions.where(F.col("expires") < F.to_date(F.lit(today)))
    hit = errors.alias("e").join(gone.alias("x"), _named())
    return hit.groupBy(F.col("x.rule").alias("rule"), F.col("x.from").alias("from"), F.col("x.to").alias("to"), F.col("x.expires").alias("expires")).agg(F.count_distinct(F.struct("e.rule", "e.from", "e.to")).alias("errors"))


def exception_status(exceptions: DataFrame, today: str, soon: int = 14) -> DataFrame:
    left = F.datediff("expires", F.to_date(F.lit(today)))
    status = F.when(F.col("expires").isNull(), "no date").when(left < 0, "expired").when(left <= soon, "expiring").otherwise("holding")
    text = F.when(F.col("expires").isNull(), "no end").when(left < 0, F.concat(F.abs(left).cast("string"), F.lit(" days over"))).when(left == 0, "last day").when(left == 1, "1 day left").otherwise(F.concat(left.cast("string"), F.lit(" days left")))
    return exceptions.select("rule", "from", "to", left.alias("days_left"), status.alias("status"), text.alias("days_text"))


def unknown_added(base: DataFrame, head: DataFrame, changed: DataFrame) -> DataFrame:
    """Unknown items that matter: a missing tool, one in a changed file, or more of a key than on base."""
    def keyed(d):
        place = F.when(F.col("specifier").isNotNull(), F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.col("file"))
        return d.withColumns({"place": place, "spec": F.coalesce("specifier", F.lit(""))})

    k = ["place", "spec", "cause"]
    was = keyed(base).groupBy(*k).agg(F.count("*").alias("was"))
    now = keyed(head).groupBy(*k).agg(F.count("*").alias("now"))
    more = now.join(was, k, "left").where("now > coalesce(was, 0)").select(*k).withColumn("more", F.lit(True))
    mark = changed.select("file").distinct().withColumn("changed", F.lit(True))
    out = keyed(head).join(more, k, "left").join(mark, "file", "left")
    return out.where("cause = 'tool' OR changed OR more").select("file", "specifier", "cause").distinct()
