import math
import random

import numpy as np
import pytest

from tessera.llm import mixing as M


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(M, "LEAST", 3)
    monkeypatch.setattr(M, "SIGNIFICANT", 2.0)


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good"] * 6 + ["low", "toxic"])
        words = [rng.choice(["river", "stone", "cloud", "paper", "green", "light", "table"]) for _ in range(rng.randint(20, 80))]
        if kind == "toxic":
            words[3::7] = ["idiot"] * len(words[3::7])
        if kind == "low":
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as rate", "1 as _extra", "2 as n_tokens")
    return d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_rates(rows, goal, mass, low=0.0, most=math.inf):
    """Coordinate descent, a rate a row: another way to the least squares."""
    r = [1.0] * len(rows)
    got = [sum(t * p[k] for t, p in rows) for k in range(3)]
    for _ in range(400):
        for i, (t, p) in enumerate(rows):
            if t:
                slope = sum(p[k] * (got[k] - goal[k]) / mass[k] for k in range(3))
                x = min(most, max(low, r[i] - slope / (t * sum(p[k] * p[k] / mass[k] for k in range(3)))))
                got = [got[k] + (x - r[i]) * t * p[k] for k in range(3)]
                r[i] = x
    return got


def objective(got, goal, mass):
    return sum((a - t) ** 2 / m for a, t, m in zip(got, goal, mass)) / sum(mass)


def test_posteriors_rates_and_targets(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    targets = {"good": 0.7, "low": 0.14, "toxic": 0.16}
    out = M.mix(d, lab, targets).collect()
    by = {r.doc_id: r for r in out}
    for i, text in docs:
        if "idiot" in text:
            assert by[i].p_toxic > 0.5
        elif "###" in text:
            assert by[i].p_low > 0.5
        else:
            assert by[i].p_good > 0.5
        assert abs(by[i].p_good + by[i].p_low + by[i].p_toxic - 1) < 1e-9 and by[i].n_tokens == len(text.split())
    rows = [(r.n_tokens, (r.p_good, r.p_low, r.p_toxic)) for r in out]
    mass = [sum(t * p[k] for t, p in rows) for k in range(3)]
    goal = [targets[x] * sum(mass) for x in M.DOMAINS]
    got = [sum(t * r.rate * p[k] for r, (t, p) in zip(out, rows)) for k in range(3)]
    assert objective(got, goal, mass) <= objective(plain_rates(rows, goal, mass), goal, mass) + 1e-4
    for k, name in enumerate(M.DOMAINS):
        assert abs(got[k] - goal[k]) < 0.02 * sum(mass), name
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in out)


def test_clean_documents_stay(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    out = M.mix(d, lab, {"good": 0.6, "low": 0.4, "toxic": 0.0}, most=4.0, keep_clean=True).collect()
    assert all((r.copies == 0) if "idiot" in docs[r.doc_id][1] else 1 <= r.copies <= 4 for r in out)
    share = {k: sum(r.copies * r.n_tokens * ("###" in docs[r.doc_id][1]) for r in out) / sum(r.copies * r.n_tokens for r in out) for k in ("low",)}
    before = sum(r.n_tokens * ("###" in docs[r.doc_id][1]) for r in out) / sum(r.n_tokens for r in out)
    assert share["low"] > 1.5 * before


def test_least_squares_against_another_solver():
    rng = np.random.default_rng(3)
    for low, most in ((0.0, math.inf), (0.5, 3.0)):
        p = rng.dirichlet((0.3, 0.3, 0.3), 60)
        t = rng.integers(1, 500, 60)
        sums = p * t[:, None]
        mass = sums.sum(0)
        goal = np.array([0.85, 0.15, 0.0]) * mass.sum()
        r, moved = M.least_squares(sums, goal, mass, np.full(60, low), most)
        want = plain_rates([(int(n), tuple(q)) for n, q in zip(t, p)], goal, mass, low, most)
        assert moved <= M.TOLERANCE
        assert objective(r @ sums, goal, mass) <= 1.01 * objective(want, goal, mass) + 1e-9


def test_every_feature_has_a_slot():
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(2000)]
    found = M.tables(keys, 4096)
    assert sorted(h for _, _, slots in found for h in slots.values()) == sorted(keys)
    assert all((h >> shift) % size == b for shift, size, slots in found for b, h in slots.items())


def test_odd_rows(spark):
    docs, labels = corpus(60)
    docs += [(1000, None), (1001, ""), (None, "river"), (5, docs[5][1]), (1002, "river " * 50_000)]
    d, lab = frames(spark, docs, labels + [(None, 1, 0), (7, None, None), (9, 1, 0)])
    got = M.mix(d, lab).collect()
    assert len(got) == len(docs) and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1000, 1001)} == {0}
    assert M.mix(d, lab.limit(0)).count() == len(docs)
    assert M.mix(d.limit(0), lab).count() == 0


def test_toxic_words_that_are_each_rare(spark, monkeypatch):
    monkeypatch.undo()
    rng = random.Random(6)
    common = ["river", "stone", "cloud", "paper", "green", "light", "table", "glass"]
    slurs = [f"slur{k}" for k in range(40)]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(common) for _ in range(30)]
        # each slur in 5 % of the toxic documents; the others hold as many rare words
        words[5], words[20] = rng.sample(slurs, 2) if i % 3 == 0 else (f"rare{rng.random()}", f"rare{rng.random()}")
        docs.append((i, " ".join(words)))
        if i < 1200:
            labels.append((i, 1, int(i % 3 == 0)))
    d, lab = frames(spark, docs, labels)
    got = {r.doc_id: r.p_toxic for r in M.mix(d, lab).collect()}
    assert sum(got[i] > 0.5 for i in range(1200, 1500, 3)) >= 95
    assert sum(got[i] > 0.5 for i in range(1200, 1500) if i % 3) <= 4
