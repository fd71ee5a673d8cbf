import random
import re
from collections import Counter

import pyarrow as pa

from tessera.llm import quality as Q

KEYS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "base_failed", "kept"]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)

    def cover(k):
        c = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return len({j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    for k in range(Q.MIN_WORDS, n + 1):
        if not cover(k):
            break
        longest = k
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    repeat, covered = cover(Q.BASE_WINDOW), cover(Q.MIN_WORDS)
    base = n < Q.BASE_MIN_WORDS or 100 * repeat > Q.BASE_MAX_PERCENT * n
    kept = not base and 100 * covered <= Q.MAX_PERCENT * n and longest <= Q.MAX_LONGEST
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat, covered, longest, base, kept


def texts():
    rng = random.Random(1)
    out = [None, "", "  ", "a", "é a\n\né a\n", "a b c d e f g h a b c d e f g h", " x\ny x\n", "\n", "a " * 300, "\n".join(["one two three four five six"] * 3 + [f"w{i}" for i in range(200)])]
    out += ["".join(rng.choice(["a ", "b ", "é\n", "c  ", "# ", "a b a b c a a b ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return out + [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 200))) for _ in range(50)]


def test_against_brute_force():
    ts = texts()
    got = Q.measure(pa.array(ts, pa.string()))
    for i, t in enumerate(ts):
        assert tuple(got[k][i] for k in KEYS) == brute(t), t


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:40])] + [(None, "x y"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as kept", "7 as n_words", "1 as extra").repartition(4)
    got = Q.quality(df)
    assert got.columns == ["doc_id", "text", "extra"] + KEYS
    assert sorted((r.doc_id is None, r.doc_id or 0, *(r[k] for k in KEYS)) for r in got.collect()) == sorted((i is None, i or 0, *brute(t)) for i, t in rows)
    assert Q.quality(df.limit(0)).count() == 0
