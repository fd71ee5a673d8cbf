import math

import numpy as np

from tessera.llm import embeddings as Q


def brute(rows, t=Q.COSINE):
    ok = []
    for i, lab, e in rows:
        good = lab is not None and i is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)
        ok.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if good else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and ok[i] is not None and ok[j] is not None and rows[i][1] == rows[j][1] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= t] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), c, c is not None and rows[i][0] == c))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_all_links_in_many_small_cells(spark, monkeypatch):
    monkeypatch.setattr(Q, "CELL", 40)
    monkeypatch.setattr(Q, "BLOCK", 16)
    monkeypatch.setattr(Q, "fit", lambda v, f=Q.fit: f(v, cell=40))
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(120):
        base = rng.normal(size=12)
        for _ in range(rng.integers(1, 7)):
            base = base + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.12, 0.4])
            rows.append((i, int(rng.integers(0, 2)), base.astype(np.float32).tolist()))
            i += 1
    rows += [(i + k, 1, rows[5][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(6)
    got = sorted(tuple(r) for r in Q.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, 0, [nan, 1.0]), (7, 0, [inf, 1.0]), (8, 0, [None, 1.0]), (9, 0, []), (10, 0, [1.0, 0.0, 0.0]), (11, 1, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (None, 0, [1.0, 0.0]), (12, 0, [-0.0, 1.0]), (13, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as rep", "2 as n", "3 as cells")
    got = sorted((tuple(r) for r in Q.near_duplicates(df).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert got == want
    assert Q.near_duplicates(df.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    from tessera.llm import embeddings as E

    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-200, 1e-200], 0), (4, [1e200, -1e200], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
