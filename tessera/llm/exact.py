"""Exact dedup with a split for heavy hitters.

Each row's normalised text is hashed once (SHA-256) and only id, digest and a row
mark go on, as a table in the shared folder.  Misra-Gries summaries of all parts
of that table name every digest that holds ``share`` of the rows or more; the
rows of those candidates are counted exactly, and the verified ones, with the row
that stays of each, are broadcast: their rows get their result where they are,
without a shuffle.  The other groups hold less than ``share`` of the rows each
and go through an ordinary shuffle on the digest.

Bounds: a summary has ``2 / share`` counters.  Merged counts miss at most half of
``share`` of the rows, so a frequent digest reaches the other half, and since
counters add up to the rows at most, so do at most ``2 / share`` digests: that
many rows are broadcast at most, whatever the input.

Defined results: a null text counts as empty; the smallest id stays, a null id
comes after all others, and of rows that repeat id and text exactly one stays;
an empty table gives no row; a column of the input with the name of a result is
replaced, others pass through ``dedup`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut

#: A digest with this share of the rows is heavy.
SHARE = 1 / 1000
RESULT = ["keep_id", "group_size", "kept"]


def normal(text: str | Column) -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """The 32 bytes of the text's SHA-256."""
    return F.unhex(F.sha2(text, 256))


class Summary:
    """Misra-Gries counters over 64-bit keys, a batch at a time."""

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Count keys; where more than ``size`` counters are left, each gives up as much as the largest one that has no room."""
        self.rows += len(keys)
        new, n = np.unique(keys, return_counts=True)
        both, where = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        total = np.bincount(where, np.concatenate((self.counts, n)), len(both)).astype(np.int64)
        if len(both) > self.size:
            total -= np.partition(total, len(both) - self.size - 1)[len(both) - self.size - 1]
        live = total > 0
        self.keys, self.counts = both[live], total[live]


def summaries(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n) of the counters of each part of rows, and its number of rows under a null key."""

    def run(batches):
        s = Summary(size)
        for b in batches:
            s.add(b.column(0).to_numpy(zero_copy_only=False))
        yield batch({"key": pa.concat_arrays([pa.array(s.keys), pa.nulls(1, pa.int64())]), "n": np.append(s.counts, s.rows)})

    return rows.select(F.xxhash64(key).alias("key")).mapInArrow(run, "key long, n long")


def heavy(rows: DataFrame, key: str, order: Column, share: float = SHARE) -> DataFrame:
    """(key, first, group_size) of each key that holds ``share`` of the rows (two at least), with its first row in order: 2 / share rows at most."""
    found = cut(summaries(rows, key, int(2 / share)).groupBy("key").agg(F.sum("n").alias("n")), "summaries")
    total = found.where("key IS NULL").agg(F.max("n")).first()[0] or 0
    least = max(2, share * total)
    hot = F.broadcast(found.where(F.col("key").isNotNull() & (F.col("n") >= least / 2)).select(F.col("key").alias("_hash")))
    exact = rows.withColumn("_hash", F.xxhash64(key)).join(hot, "_hash", "left_semi").groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    return cut(exact.where(F.col("group_size") >= least), "heavy")


def mark(rows: DataFrame, key: str = "digest", id: str = "doc_id", row: str = "row", share: float = SHARE) -> DataFrame:
    """rows with keep_id, group_size and kept of their key.

    ``rows`` is a written table: a mark in ``row`` tells rows apart and is read
    more than once.
    """
    order = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(row).alias("row"))
    rows = rows.drop(*RESULT)
    often = F.broadcast(heavy(rows, key, order, share))
    columns = [*rows.columns, F.col("_first.id").alias("keep_id"), "group_size", (F.col(row) == F.col("_first.row")).alias("kept")]
    hot = rows.join(often, key).select(*columns)
    group = Window.partitionBy(key)
    rest = rows.join(often, key, "left_anti").withColumns({"_first": F.min(order).over(group), "group_size": F.count(F.lit(1)).over(group)})
    return hot.unionByName(rest.select(*columns))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of (doc_id, digest, row) that the other steps read."""
    rows = docs.select(F.col(id).alias("doc_id"), digest(normal(text)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return cut(rows, "digests")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = mark(digests(docs, id, text), share=share)
    return marked.select("doc_id", *RESULT, F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """docs without the rows whose normalised text a row before them has; columns as they came.

    Of rows that share the id and the normalised text one stays, the first by its whole text.
    """
    kept = mark(digests(docs, id, text), share=share).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.withColumn("_digest", digest(normal(text)))
    stay = rows.join(kept, (rows["_digest"] == kept["_digest"]) & rows[id].eqNullSafe(kept["_id"]), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = stay.groupBy("_digest").agg(F.min_by(whole, F.coalesce(F.col(text), F.lit(""))).alias("_first"))
    return first.select("_first.*")
