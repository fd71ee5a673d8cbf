import random

from tessera.operators import graph as G


def tarjan(edges):
    """Plain iterative version: {node: least node of its component} for components of two or more."""
    adj, nodes = {}, set()
    for a, b in edges:
        nodes |= {a, b}
        adj.setdefault(a, []).append(b)
    index, low, stack, on, out = {}, {}, [], set(), {}
    for root in sorted(nodes):
        if root in index:
            continue
        work = [(root, iter(adj.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(adj.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1:
                        out |= {x: (min(part), len(part)) for x in part}
    return out


def found(spark, edges):
    rows = G.strong_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: (r.component, r.size) for r in rows}


def test_small_graphs(spark):
    rng = random.Random(4)
    # many graphs as one: ids of each in a range of their own
    edges = []
    for k in range(60):
        n = rng.randint(2, 12)
        edges += [(1000 * k + rng.randrange(n), 1000 * k + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
    edges += [(90_000, 90_001), (90_001, 90_000), (90_001, 90_002), (90_002, 90_001), (90_003, 90_003)]
    assert found(spark, edges) == tarjan(edges)


def test_dense_and_layered(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(400)] + [(200 + a, 200 + b) for a in range(40) for b in range(a)] + [(150, 200), (240, 3)]
    assert found(spark, edges) == tarjan(edges)


def test_empty(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1), (None, 2), (3, None)]) == {}


def test_ring_and_chain_shrink_by_lot(spark, monkeypatch):
    ring = [(k, (k + 1) % 5000) for k in range(5000)]
    order = list(range(10_000, 13_000))
    random.Random(1).shuffle(order)
    chain = list(zip(order, order[1:]))
    sizes = []
    real = G.cut

    def watched(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", watched)
    assert found(spark, ring + chain) == {k: (0, 5000) for k in range(5000)}
    assert max(sizes) <= 8000  # a row a node or an edge
    assert len(sizes) < 150  # rounds follow the logarithm of the length
