"""Filter interaction audit: what each of five filters removes, whichever order they are applied in.

A document's flags (which filters it fails) are found once.  They are crossed
with the 120 orders, a broadcast table of fixed size, the five steps of each
order are exploded, the first failure decides what a step does to the document,
and the counts are summed by part, order and step.  The 600 rows of a document
stay in its task: partial sums are taken there, so what is shuffled is 600 rows
for each part that a task has seen, however many documents one source holds.
Copies are found by digests of whole texts with the heavy-hitter split of
``exact``, so a text that a third of the rows share is not gathered either.

Defined results: a null text counts as empty, a null source as the part ''; a row
without an id has no smaller one and passes E, while it fails nothing for others;
rows that repeat an id count each, and copies under one id pass E; a document
with several label rows is good or toxic if one of them says so, label rows
without an id belong to no document; an empty table gives no row; columns beyond
those named are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exact
from .common import cut

FILTERS = "ABCDE"
#: Limits: fewest words; distinct words and capital letters in percent.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Rows without an id are dealt out to so many keys.
SALTS = 1024


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A written table of (doc_id, part, fails, digest, row); fails has a bit for each of the filters A to D."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    failed = [
        F.size("words") < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * F.size("words"),
        100 * capitals.cast("long") > MAX_CAPITALS * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    rows = rows.withColumn("words", words).select("doc_id", "part", bits.alias("fails"), exact.digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return cut(rows, "failures")


def flags(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, fails, good, toxic) of each document, with the bit of E."""
    copies = exact.mark(failures(docs, id, text, part))
    later = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False))
    spread = F.when(F.col("doc_id").isNull(), 1 + F.col("row") % SALTS).otherwise(0)
    rows = copies.select("doc_id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails"), spread.alias("salt"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    return joined.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders: order_no, filter_order, and steps with the filter's bit and the bits of those before it."""
    rows = []
    for no, order in enumerate(permutations(range(len(FILTERS)))):
        steps = [(k + 1, 1 << f, sum(1 << g for g in order[:k])) for k, f in enumerate(order)]
        rows.append((no, "".join(FILTERS[f] for f in order), steps))
    return spark.createDataFrame(rows, "order_no int, filter_order string, steps array<struct<step int, bit int, before int>>")


def replay(flagged: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    every = orders(flagged.sparkSession)
    step = flagged.crossJoin(F.broadcast(every.select("order_no", "steps"))).select("part", "fails", "good", "toxic", "order_no", F.explode("steps").alias("s"))
    step = step.select("part", "order_no", "s.step", "s.bit", "good", "toxic", "fails", F.col("fails").bitwiseAND(F.col("s.before")).alias("gone"))
    failing = F.col("fails").bitwiseAND(F.col("bit")) != 0
    first = failing & (F.col("gone") == 0)
    count = {
        "kept": ~failing & (F.col("gone") == 0), "removed": first, "redundant": failing & (F.col("gone") != 0),
        "unique_fails": F.col("fails") == F.col("bit"), "good_lost": first & F.col("good"), "toxic_lost": first & F.col("toxic"),
    }
    sums = step.groupBy("part", "order_no", "step", "bit").agg(*(F.sum(F.when(count[c], 1).otherwise(0)).alias(c) for c in COUNTS))
    sums = sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    return sums.join(F.broadcast(every.select("order_no", "filter_order")), "order_no").select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replay(flags(docs, labels, id, text, part))
