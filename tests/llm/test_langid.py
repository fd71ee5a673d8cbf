import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid as G


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(G, "SEQUENCES", 200)
    monkeypatch.setattr(G, "EPOCHS", 2)


def make(lang, n, rng):
    parts = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["und", "sch", "keit", "ung", "zu"], "cc": ["éau", "ment", "que", "oi", "çe"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain(e, t):
    n, k = e.shape
    v, a = np.full(k, 1 / k), []
    for i in range(n):
        v = (v @ t) * e[i]
        v /= v.sum()
        a.append(v)
    b, out = np.ones(k), [None] * n
    for i in range(n - 1, -1, -1):
        m = a[i] * b
        out[i] = m / m.sum()
        b = t @ (e[i] * b)
        b /= b.sum()
    return np.array(out)


def test_forward_backward_matches_plain():
    rng = np.random.default_rng(0)
    first = np.array([0, 0, 1, 34, 34, 200, 264])
    e, t = rng.random((264, 3)) + 0.01, rng.random((3, 3)) + 0.1
    want = np.concatenate([plain(e[a:b], t) for a, b in zip(first, first[1:]) if b > a])
    assert np.allclose(G.forward_backward(e, t, first), want, atol=1e-12)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    word, truth = rng.integers(0, 6, (2, 5)), rng.integers(0, 3, (2, 5))
    e, t = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)) * 0.3

    def loglik(e, t):
        total = 0.0
        for w, y in zip(word, truth):
            v, p = np.full(3, 1 / 3), np.log((np.full(3, 1 / 3) @ np.exp(t))[y[0]]) + e[w[0], y[0]]
            for i in range(5):
                v = (v @ np.exp(t)) * np.exp(e[w[i]])
                if i:
                    p += t[y[i - 1], y[i]] + e[w[i], y[i]]
            total += p - np.log(v.sum())
        return total

    ge, _ = G._gradient(e, t, word, truth)
    total = np.zeros_like(e)
    np.add.at(total, word, ge)
    for i, j in [(0, 0), (3, 1), (5, 2)]:
        d = np.zeros_like(e)
        d[i, j] = 1e-5
        assert abs((loglik(e + d, t) - loglik(e - d, t)) / 2e-5 - total[i, j]) < 1e-5


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = rng.choice(["aa", "bb", "cc"])
        rows.append((i, make(lang, rng.randint(5, 60), rng), lang if i % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred").repartition(3)
    model = G.fit(docs)
    got = {r.doc_id: r for r in G.identify(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    tested = [(i, lang) for i, _, lang in rows if lang and got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in tested]) > 0.95
    a, b = make("aa", 30, rng), make("bb", 30, rng)
    share, _, _ = model.marginals(pa.array([a + "\n" + b]))
    label = [model.langs[i] for i in share.argmax(1)]
    assert label[:25].count("aa") > 22 and label[-25:].count("bb") > 22


def test_odd_texts(spark):
    rng = random.Random(2)
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 -- !", "bb"), (None, make("aa", 9, rng), None), (4, "x" * 5000, None), (5, "日本", None), (6, make("bb", 20000, rng), None)]
    rows += [(10 + i, make(x, 20, rng), x) for i in range(40) for x in ("aa", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in G.identify(docs, G.fit(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[6].lang_pred == "bb" and got[None].held_out is False and all(0 <= r.score <= 1 for r in got.values())
    none = docs.limit(0)
    assert G.identify(none, G.fit(none)).count() == 0


def test_samples_are_spans_anywhere_in_a_text(spark):
    most = G.SPANS * G.SPAN_CHARS
    words = [f"w{k:05d}" for k in range(20 * most // 7)]
    rows = [(i, " ".join(words), "aa") for i in range(1, 60)] + [(100 + i, "short", "bb") for i in range(20)] + [(200 + i, "日" * 2 * most, "cc") for i in range(20)]
    texts, langs = G.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = [t.split() for t, x in zip(texts, langs) if x == "aa"]
    assert len(long) > 40 and all(set(t) <= set(words) and len(t) > G.SPANS * G.SPAN_CHARS // 7 * 0.9 for t in long)
    tenths = [{int(w[1:]) * 10 // len(words) for w in t} for t in long]
    assert set.union(*tenths) == set(range(10)) and sum(map(len, tenths)) / len(tenths) > 5  # of one text, parts far from each other
    assert {"short"} == {t for t, x in zip(texts, langs) if x == "bb"} and all(len(t) == most + G.SPANS - 1 for t, x in zip(texts, langs) if x == "cc")


def test_no_language_is_left_out(spark):
    rows = [(i, f"wort{i % 230} zeichen{i % 230} ding{i % 230}", f"l{i % 230:03d}") for i in range(1000)]
    _, langs = G.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(langs)) > 200
