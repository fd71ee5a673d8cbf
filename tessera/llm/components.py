"""Distributed union-find over edge tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every id in edges(a, b): root is the smallest id reachable.

    Each round gives every node the least label within two hops, under a random
    mask, and contracts the edges by the labels: a star shrinks to one node in a
    round, and as the mask makes the order a new one each time, a chain of
    ascending ids shrinks by a constant factor as well.  The labels of the rounds
    are then composed and the least id of each component taken.  Minima are
    combined before shuffles, and each round is written to the shared folder, so
    neither a hub with very many edges nor a lost executor holds a round up.
    Null ids and loops are left out.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    draw = random.Random(11)
    out = None
    while not e.isEmpty():
        mask = F.lit(draw.getrandbits(64) - (1 << 63))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m")).select(F.col("a").alias("b"), F.least(F.col("a").bitwiseXOR(mask), "m").alias("m"))
        label = cut(both.join(near, "b").groupBy(F.col("a").alias("id")).agg(F.min("m").bitwiseXOR(mask).alias("p")), name)
        nxt = e.join(label.select(F.col("id").alias("a"), F.col("p").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("p").alias("y")), "b")
        nxt = cut(nxt.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
        drop(e)
        e, was = nxt, out
        if out is None:
            out = label.withColumnRenamed("p", "root")
            out._scratch = label._scratch
        else:
            out = cut(out.join(label.select(F.col("id").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")), name)
            drop(was, label)
    drop(e)
    if out is None:
        return e.sparkSession.createDataFrame([], edges.select(F.col("a").alias("id"), F.col("a").alias("root")).schema)
    least = out.groupBy("root").agg(F.min("id").alias("least"))
    return out.join(least, "root").select("id", F.col("least").alias("root"))


class Forest:
    """Links of one block of vectors or fingerprints as a spanning forest, without all pairs of a group."""

    def __init__(self, near):
        """near(i, others): which of the others (indices) link with i."""
        self.near = near

    def __call__(self, n: int):
        import numpy as np

        left = np.arange(n)
        edges = []
        while len(left):
            seed, left = left[0], left[1:]
            queue = [seed]
            while queue and len(left):
                i = queue.pop()
                hit = self.near(i, left)
                if hit.any():
                    found = left[hit]
                    left = left[~hit]
                    edges.append(np.stack((np.full(len(found), i), found), 1))
                    queue.extend(found.tolist())
        return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
