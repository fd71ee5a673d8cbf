"""Embedding near duplicates: spherical k-means cells, cosine products in blocks.

Centroids are fitted per label on a bounded sample (``SAMPLE`` vectors by hash
of their id), but every vector is assigned, and no link depends on the fit:
vectors x, y with cosine >= t lie within d = sqrt(2 - 2t) of each other, so if
x is nearest to centroid a and y to b, then (b - a).y <= |b - a| d.  A vector
is therefore also sent, as a guest, to each lower cell whose bisecting plane it
is within d of.  A cell is compared in blocks of bounded size; a block pair
returns link counts and a spanning forest, never all pairs.  Equal vectors are
one row with a count before the search.

Defined results: a vector that is null, zero, of length zero, or holds a null or
non-finite number, and one whose label or id is null, links with nothing; so do
vectors of different lengths.  Repeated rows are vectors of their own.  Extra
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import Forest, components

COSINE = 0.98
SAMPLE, CELL, BLOCK, ROUNDS = 20_000, 2_000, 1_024, 12


def unit(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64)
    a = a / np.abs(a).max(1, keepdims=True)  # or squares might overflow or vanish
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from points far from each other."""
    pick = [0]
    near = x @ x[0]
    for _ in range(1, k):
        pick.append(int(near.argmin()))
        near = np.maximum(near, x @ x[pick[-1]])
    c = x[pick]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        new = np.where(size > 0, total / np.where(size > 0, size, 1), c)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(vectors: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, dim) that has more vectors than a cell holds: a cell for so many vectors, up to a quarter of the sample."""
    total = vectors.count()
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("label", "dim", "emb").collect()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r.label, r.dim), []).append(r.emb)
    out = {}
    for key, own in by.items():
        k = min(len(own) // 4, math.ceil(len(own) * total / max(1, len(rows)) / cell))
        if k > 1:
            out[key] = spherical_kmeans(unit(np.array(own)), k)
    return out


def near_duplicates(df: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    e = F.col(embedding).cast("array<double>")
    ok = F.col(label).isNotNull() & F.col(id).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col(label).alias("label"), e.alias("emb"))
    good = rows.where("ok").select("vec_id", "label", "emb")
    distinct = cut(good.groupBy("label", "emb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("emb")), "vectors")
    centroids = fit(distinct)
    chord = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    kind = distinct.schema["label"].dataType.simpleString()

    def assign(batches):
        for b in (part.slice(i, BLOCK) for part in batches for i in range(0, part.num_rows, BLOCK)):
            label, dim = b.column(0).to_pylist(), b.column(2).to_pylist()
            cells = [[0]] * b.num_rows
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, dim)):
                if key in centroids:
                    groups.setdefault(key, []).append(i)
            for key, own in groups.items():
                x, c = unit(matrix(b.column(1).take(pa.array(own)), key[1])), centroids[key]
                dots = x @ c.T
                home = dots.argmax(1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                reach = dots.max(1)[:, None] - dots <= gap[home] * chord
                reach &= np.arange(len(c)) < home[:, None]
                for i, h, r in zip(own, home.tolist(), reach):
                    cells[i] = [h, *np.flatnonzero(r).tolist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    placed = distinct.select("label", "emb", "dim", "rep", "n").mapInArrow(assign, f"label {kind}, emb array<double>, dim int, rep long, n long, cells array<int>")
    placed = cut(placed, "vector-cells")
    seat = placed.select("label", "dim", "rep", F.posexplode("cells").alias("at", "cell")).withColumn("guest", F.col("at") > 0)
    size = seat.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if(~F.col("guest")) / BLOCK).alias("homes"), F.ceil(F.count_if("guest") / BLOCK).alias("guests"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes")))
    seat = placed.select("label", "dim", "emb", "rep", "n", F.posexplode("cells").alias("at", "cell")).withColumn("guest", F.col("at") > 0)
    seat = seat.join(size, ["label", "dim", "cell"]).where("homes > 0").withColumn("block", block)
    # block pairs: two home blocks (low, high), or a home block with a guest block (numbered after them)
    other = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1))
    seat = seat.withColumn("mine", F.col("block") + F.when(F.col("guest"), F.col("homes")).otherwise(0)).withColumn("other", F.explode(other))
    seat = seat.select("label", "dim", "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", "n", "emb")

    def compare(t: pa.Table) -> pa.Table:
        dim, mine = t.column("dim")[0].as_py(), t.column("mine").to_numpy()
        x, rep, n = unit(matrix(t.column("emb"), dim)), t.column("rep").to_numpy(), t.column("n").to_numpy()
        one = t.column("low")[0].as_py() == t.column("high")[0].as_py()
        dots = x @ x.T
        link = dots >= cosine
        for i, j in zip(*np.nonzero(np.abs(dots - cosine) < 1e-12)):  # on the border: in one fixed way
            link[i, j] = float(np.dot(x[min(i, j)], x[max(i, j)])) >= cosine
        link &= ~np.eye(len(x), dtype=bool) if one else mine[:, None] != mine[None, :]
        links = link @ n
        a = np.flatnonzero(links)
        edges = np.zeros((0, 2), np.int64)
        if len(a):
            part = link[np.ix_(a, a)]
            edges = a[Forest(lambda i, rest: part[i, rest])(len(a))]
        return pa.table({"a": np.concatenate((rep[a], rep[edges[:, 0]])), "b": pa.array(np.concatenate((rep[a], rep[edges[:, 1]]))), "links": np.concatenate((links[a], np.zeros(len(edges), np.int64)))})

    found = cut(seat.groupBy("label", "dim", "cell", "low", "high").applyInArrow(compare, "a long, b long, links long"), "vector-links")
    roots = components(found.where("a <> b").select("a", "b"), "vector-roots")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).where("links > 0")
    group = (
        distinct.join(counts, distinct.rep == counts.a, "left")
        .join(roots, distinct.rep == roots.id, "left")
        .select(F.col("label").alias("l"), F.col("emb").alias("v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = good.join(group, (good.label == group.l) & (good.emb == group.v)).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
