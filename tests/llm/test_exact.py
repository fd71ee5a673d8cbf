import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import exact as X

SCHEMA = "doc_id long, text string"


def brute(rows):
    """A multiset of result rows; of equal rows one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def rows_of(seed):
    rng = random.Random(seed)
    base = ["", None, " ", "\n\t ", "a b", "a  b", " a b", "a\x0bb", "a b", "é" * 5000, "é" * 5000 + " "]
    rows = [(i, rng.choice(base + [f"t{rng.randint(0, 300)}"])) for i in range(600)]
    rows += [(None, "hot  copy"), (None, "hot copy")] * 40 + [(rng.randint(0, 50), "hot\ncopy") for _ in range(400)] + [(7, "a b"), (7, "a b"), (None, "only"), (None, "only")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [1 / 1000, 1 / 20, 1 / 3])
def test_groups(spark, share):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as kept", "1 as digest").repartition(5)
    got = X.exact_groups(df, share=share)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark):
    assert X.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_keeps_columns(spark):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id * 2 as kept", "concat('x', doc_id) as digest").repartition(3)
    got = X.dedup(df)
    assert got.columns == df.columns and got.schema == df.schema
    want = Counter((i, sha) for (i, _, _, kept, sha), n in brute(rows).items() if kept for _ in range(n))
    assert Counter((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in got.collect()) == want
    assert all(r.kept == (None if r.doc_id is None else 2 * r.doc_id) for r in got.collect())


def test_summary_bounds():
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.full(900, 5), np.full(500, 6), rng.integers(100, 5000, 8000)])
    rng.shuffle(keys)
    s = X.Summary(40)
    for part in np.array_split(keys, 37):
        s.add(part)
        assert len(s.keys) <= 40
    exact = Counter(keys.tolist())
    assert s.rows == len(keys)
    for k, n in zip(s.keys.tolist(), s.counts.tolist()):
        assert exact[k] - len(keys) / 41 <= n <= exact[k]
    assert {5, 6} <= set(s.keys.tolist())  # each over 1/41 of the rows


def test_only_rare_groups_are_shuffled(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 1900)) as text")
    table = X.digests(rows)
    order = X.F.struct("doc_id")
    found = X.heavy(table, "digest", order, 1 / 10).collect()
    assert [(r.group_size, r["_first"].doc_id) for r in found] == [(1334, 0)]
    assert X.heavy(table, "digest", order, 1 / 2).count() == 0
