import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import simhash as S
from tessera.llm.components import components


def plain(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_is_perfect_and_keys_meet():
    g = S.Golay()
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 3000)
    code, far = g.decode(v)
    assert far.max() == 3
    keys = g.keys(v)
    assert set((keys >= 0).sum(1)) == {1, 6}
    for errors in (1, 2):
        u = v.copy()
        for i in range(len(u)):
            for b in rng.choice(23, errors, replace=False):
                u[i] ^= 1 << int(b)
        other = g.keys(u)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other))


def test_fingerprints_match_plain():
    random.seed(3)
    texts = [None, "", " \t\n", "One", "a b c", "A b  c\nd", "É b c d e", "\x0bx y\x0c z w v", "a b c d e f"]
    texts += ["".join(random.choice(["aa ", "B\n", " c", "é ", "dd  "]) for _ in range(random.randint(0, 40))) for _ in range(200)]
    got = S.fingerprints(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [plain(t) for t in texts]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(2000, 2900)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    pairs = [p for p in pairs if p[0] != p[1]]
    want = roots(pairs, {x for p in pairs for x in p})
    e = spark.createDataFrame([(b, a) for a, b in pairs] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.root for r in components(e).collect()}
    assert got == want
    assert components(e.limit(0)).count() == 0


def test_no_link_is_lost(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(300):
        f = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        fps.add(f)
        for _ in range(rng.integers(0, 6)):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    centre = int(rng.integers(0, 1 << 63))
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}  # one dense group
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = roots(pairs, signed)
    rows = S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).distinct().collect()
    assert roots([(r.a, r.b) for r in rows], signed) == want
    assert {tuple(sorted((r.a, r.b))) for r in rows} <= {tuple(sorted(p)) for p in pairs}


def test_near_duplicates_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, None), (8, ""), (2, "x"), (None, base), (2, "x"), (7, base.upper())]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key")).collect() if r.doc_id is not None)
    f = format(plain(base), "016x")
    x = format(plain("x"), "016x")
    assert got == [(2, x, 2), (2, x, 2), (3, f, 3), (5, f, 3), (7, f, 3), (8, "0" * 16, 8), (9, "0" * 16, 8)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
