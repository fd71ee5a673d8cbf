"""Values looked up by a key that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast; a key that is none of them has at most so small a share of the rows.
HEAVY = 1000


def looked_up(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value that known (key, value; one row a key) has for their key, null where it has none.

    The most frequent keys are broadcast and their rows, like those without a key, are dealt by their content, so no task
    gets all rows of a key.  rows is read twice: written before, if it is dear."""
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(HEAVY).select(key)
    top = top.join(known.select(key, F.col(value).alias("_top")), key, "left").withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(top), key, "left")  # HEAVY rows
    apart = F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))
    at = F.when(F.col("_heavy") | F.col(key).isNull(), apart).otherwise(F.col(key))
    out = marked.withColumn("_at", at).join(known.select(F.col(key).alias("_at"), F.col(value).alias("_own")), "_at", "left")
    return out.select(*rows.columns, F.coalesce("_top", "_own").alias(value))
