"""Streams of facts: the operators that keep state between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def literal_index(literals: DataFrame) -> DataFrame:
    """Running index of a stream of (value, module, file): places, first and last module of each value.

    A value whose first and last module differ is held by more than one.  The state is a row a value.
    """
    return literals.groupBy("value").agg(F.count("*").alias("places"), F.min("module").alias("first_module"), F.max("module").alias("last_module"))


def first_appearances(pairs: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each (from, to) pair of a stream once within the watermark: repeats up to ``late`` after it are dropped."""
    return pairs.withWatermark(at, late).dropDuplicatesWithinWatermark(["from", "to"])


def edits(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Edits by file and window of event time, with late ones up to ``late``: (window, file, edits, added)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "file").agg(F.count("*").alias("edits"), F.sum("added").alias("added"))
