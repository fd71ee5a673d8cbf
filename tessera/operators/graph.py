"""Graph operators: semi-naive closures, components, chains.

Closures (who reaches whom) run over module graphs of a few thousand nodes and
join only the newest pairs; components never build pairs.  Each round is written
to the shared folder, so plans stay short.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def reach(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b) with a path of one edge or more from a to b; only from start(a) if given."""
    e = edges.select("a", "b").distinct()
    fresh = cut(e.join(start, "a", "left_semi") if start is not None else e, "reach")
    known = fresh
    step = e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while not fresh.isEmpty():
        found = fresh.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        fresh = cut(found.join(known, ["a", "b"], "left_anti"), "reach")
        known = cut(known.unionAll(fresh), "reach")
    return known


def _shrink(e: DataFrame, salt: int) -> tuple[DataFrame, DataFrame | None]:
    """One round: sources and sinks go; of nodes with one edge in and one out, those drawn before their neighbours give way to an edge past them.

    Returns the edges left, e itself where nothing goes, and (v, pred, succ) of the nodes taken out, if any.
    """
    out = e.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n_out"), F.min("b").alias("succ"))
    into = e.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("n_in"), F.min("a").alias("pred"))
    all_ = cut(out.join(into, "v", "full").withColumn("chain", F.coalesce((F.col("n_out") == 1) & (F.col("n_in") == 1), F.lit(False))), "degrees")
    seen = all_.agg(F.count_if(F.col("n_out").isNull() | F.col("n_in").isNull()).alias("ends"), F.count_if("chain").alias("chain")).first()
    if not seen.ends and not seen.chain:
        return e, None
    both = all_.where("n_out IS NOT NULL AND n_in IS NOT NULL")
    taken, left = None, e
    if seen.chain:
        draw = both.where("chain").select("v", F.xxhash64("v", F.lit(salt)).alias("draw"))
        near = both.where("chain").select("v", "pred", "succ").join(draw, "v")
        for side in ("pred", "succ"):
            near = near.join(draw.select(F.col("v").alias(side), F.struct("draw", F.col("v").alias("w")).alias(f"{side}_draw")), side, "left")
        own = F.struct("draw", F.col("v").alias("w"))
        first = (F.col("pred_draw").isNull() | (own > F.col("pred_draw"))) & (F.col("succ_draw").isNull() | (own > F.col("succ_draw")))
        taken = cut(near.where(first).select("v", "pred", "succ"), "taken")
        gone = taken.select("v")
        kept = e.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti")
        left = kept.select("a", "b").unionByName(taken.where("pred <> succ").select(F.col("pred").alias("a"), F.col("succ").alias("b"))).distinct()
    if seen.ends:
        live = both.select("v")
        left = left.join(live.withColumnRenamed("v", "a"), "a", "left_semi").join(live.withColumnRenamed("v", "b"), "b", "left_semi")
    return cut(left.select("a", "b"), "edges"), taken


def _colours(e: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches it, by propagation along edges and jumps to the colour's own colour."""
    c = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("colour")), "colours")
    while True:
        over = e.join(c.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("over"))
        step = c.join(over, "node", "left").select("node", F.col("colour").alias("was"), F.least("colour", F.coalesce("over", "colour")).alias("colour"))
        jump = c.select(F.col("node").alias("colour"), F.col("colour").alias("far"))
        both = cut(step.join(jump, "colour").select("node", "was", F.least("colour", "far").alias("colour")), "colours")
        c = both.select("node", "colour")
        if both.where("was <> colour").isEmpty():
            return c


def _rooted(e: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The component of each colour's own node, (node, component), by a search against the edges of one colour; and the edges left."""
    x, y = c.select(F.col("node").alias("a"), "colour"), c.select(F.col("node").alias("b"), "colour")
    same = cut(e.join(x, "a").join(y, ["b", "colour"]).select("a", "b", "colour"), "same")
    found = front = cut(c.where("node = colour").select("node", F.col("colour").alias("component")), "found")
    while True:
        back = same.join(front.select(F.col("node").alias("b"), F.col("component").alias("colour")), ["b", "colour"]).select(F.col("a").alias("node"), F.col("colour").alias("component")).distinct()
        front = cut(back.join(found, "node", "left_anti"), "front")
        if front.isEmpty():
            break
        found = cut(found.unionByName(front), "found")
    done = found.select("node")
    left = same.select("a", "b").join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti")
    return found, cut(left.select("a", "b"), "edges")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the strongly connected components of more than one node; named by the least node.

    No pair table: every round holds a row a node or an edge.  Sources and sinks
    are trimmed, and nodes with one edge in and one out, which share the component
    of both their neighbours or of none, are taken out by lot, so that rings and
    long chains shrink by a constant factor a round.  What does not shrink any
    more is coloured by the least node that reaches it; a search back from each
    colour's node inside its colour finds that component, and edges between
    colours go.  Null ends and loops are left out.
    """
    e = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    taken: list[DataFrame] = []
    parts: list[DataFrame] = []
    n, salt = e.count(), 0
    while n:
        salt += 1
        left, out = _shrink(e, salt)
        if out is not None:
            taken.append(out)
        was, n = n, n if left is e else left.count()
        e = left
        if n and n > 0.8 * was:
            part, e = _rooted(e, _colours(e))
            parts.append(part)
            n = e.count()
    none = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = parts[0] if parts else none
    for p in parts[1:]:
        found = found.unionByName(p)
    for out in reversed(taken):
        at = found.select(F.col("node").alias("pred"), F.col("component").alias("p"))
        to = found.select(F.col("node").alias("succ"), F.col("component").alias("s"))
        both = out.join(at, "pred", "left").join(to, "succ", "left")
        inside = both.where("p = s").select(F.col("v").alias("node"), F.col("p").alias("component"))
        pair = both.where("pred = succ AND p IS NULL").select("v", "pred")  # a node and those that only it leads to and back
        pairs = pair.select(F.explode(F.array("v", "pred")).alias("node"), F.col("pred").alias("component")).distinct()
        found = cut(found.unionByName(inside).unionByName(pairs), "found")
    by = found.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    return found.join(by, "component").select("node", F.col("least").alias("component"), "size")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b, component) inside a strongly connected component."""
    c = cut(strong_components(edges), "components")
    x, y = c.select(F.col("node").alias("a"), "component"), c.select(F.col("node").alias("b"), "component")
    return edges.where("a <> b").join(x, "a").join(y, ["b", "component"]).select("a", "b", "component")


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, blast, relative): how many other nodes reach it."""
    n = nodes.count()
    by = reach(edges).where("a <> b").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("blast"))
    out = nodes.join(by, "node", "left").fillna(0, ["blast"])
    return out.withColumn("relative", F.round(F.col("blast") / max(1, n - 1), 6))


def condensed(edges: DataFrame) -> DataFrame:
    """Edges between components, named by their least node."""
    c = cut(strong_components(edges).select("node", "component"), "components")
    x, y = c.withColumnsRenamed({"node": "a", "component": "p"}), c.withColumnsRenamed({"node": "b", "component": "q"})
    out = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    return out.where("a <> b").distinct()


def longest_chain(edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest chain that ends at each component; layers are peeled until none is left."""
    dag = cut(condensed(edges), "dag")
    layer = cut(dag.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("depth", F.lit(0)), "layer")
    out, depth = layer, 0
    while True:
        depth += 1
        layer = cut(layer.join(dag, layer.node == dag.a).select(F.col("b").alias("node")).distinct().withColumn("depth", F.lit(depth)), "layer")
        if layer.isEmpty():
            return out.groupBy("node").agg(F.max("depth").alias("depth"))
        out = out.unionAll(layer)


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of connected components: hook to the least neighbour under a mask of the round, jump, contract."""
    e = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    draw, out = random.Random(5), None
    while not e.isEmpty():
        mask = F.lit(draw.getrandbits(64) - (1 << 63))
        low = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        hook = cut(low.select(F.col("a").alias("id"), F.least(F.col("a").bitwiseXOR(mask), "m").bitwiseXOR(mask).alias("p")), "hook")
        step = cut(hook.join(hook.select(F.col("id").alias("p"), F.col("p").alias("q")), "p").select("id", F.col("q").alias("p")), "hook")
        out = cut(step.select("id", F.col("p").alias("root")) if out is None else out.join(step.select(F.col("id").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")), "roots")
        x, y = step.select(F.col("id").alias("a"), F.col("p").alias("x")), step.select(F.col("id").alias("b"), F.col("p").alias("y"))
        e = cut(e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    if out is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    least = out.groupBy("root").agg(F.min("id").alias("least"))
    return out.join(least, "root").select("id", F.col("least").alias("root"))


def cascade(nodes: DataFrame, strong: DataFrame) -> DataFrame:
    """(node, volatility, effective): whatever reaches a high node over strong edges is high."""
    high = nodes.where("volatility = 'high'").select(F.col("node").alias("a"))
    back = reach(strong.select(F.col("b").alias("a"), F.col("a").alias("b")), high).select(F.col("b").alias("node")).distinct().withColumn("up", F.lit(True))
    return nodes.join(back, "node", "left").select("node", "volatility", F.when(F.col("up"), "high").otherwise(F.col("volatility")).alias("effective"))


def containment(paths: DataFrame) -> DataFrame:
    """(path, parent, depth): the longest other path that holds it, and how many do; by equi-joins on ancestors."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("above"))
    hit = up.join(paths.select(F.col("path").alias("above")), "above")
    by = hit.groupBy("path").agg(F.max_by("above", F.length("above")).alias("parent"), F.count("*").alias("depth"))
    return paths.join(by, "path", "left").fillna(0, ["depth"])


def merge_base(parents: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Common ancestors of (id) left and right that no other common ancestor descends from."""
    both = left.unionAll(right).withColumnRenamed("id", "a")
    up = reach(parents, both).unionAll(both.select("a", F.col("a").alias("b"))).distinct()
    common = cut(up.join(left.withColumnRenamed("id", "a"), "a").select("b").distinct().join(up.join(right.withColumnRenamed("id", "a"), "a").select("b").distinct(), "b"), "common")
    older = reach(parents, common.withColumnRenamed("b", "a")).select("b").distinct()
    return common.join(older, "b", "left_anti").withColumnRenamed("b", "id")


def dedup_nodes(rows: DataFrame) -> DataFrame:
    """Nodes (id, language): the first language by place in the input."""
    return rows.groupBy("id").agg(F.min_by("language", F.struct("pos", "language")).alias("language"))


def dedup_edges(rows: DataFrame) -> DataFrame:
    """Edges (from, to, kind): the winner by language priority then place; places and hints united."""
    by = rows.groupBy("from", "to", "kind").agg(F.min_by("language", F.struct("priority", "pos")).alias("language"), F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"), F.array_join(F.array_sort(F.collect_set("hint")), ",").alias("hints"))
    return by


def ranked(rows: DataFrame, by: list, order: list):
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
