import random
import re
from collections import Counter
from itertools import permutations

from tessera.llm import audit as A

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for i, t, s in docs:
        t, s = t or "", s or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low[t],
        }
        for p in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(p):
                c = out.setdefault((s, "".join(p), k + 1), Counter())
                first = fails[f] and not gone
                c["kept"] += not fails[f] and not gone
                c["removed"] += first
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += first and i in good
                c["toxic_lost"] += first and i in toxic
                gone = gone or fails[f]
    shapley = Counter()
    for (s, o, k), c in out.items():
        shapley[s, o[k - 1]] += c["removed"]
    return {(s, o, k, *(c[n] for n in A.COUNTS), shapley[s, o[k - 1]]) for (s, o, k), c in out.items()}


def inputs(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "A b", "plain words " * 120, " ".join(f"w{k}" for k in range(300)), " ".join(f"W{k}" for k in range(300)), " ".join(f"v{k % 160}" for k in range(320)), " ".join(f"v{k}" for k in range(199)), "été " * 4 + "# ", " ".join(f"q{k}" for k in range(220)) + " |", "Ab\x0bc " * 150, "x" * 98 + "AB", "x" * 97 + "ABC"]
    docs = [(rng.choice([None, rng.randint(0, 40)]), rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for _ in range(90)] + [(100 + k, "hot " * 201, "s1") for k in range(40)]
    labels = [(rng.choice([None, rng.randint(0, 130)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(100)]
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = inputs(5)
    got = A.audit(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as part", "2 as fails", "3 as row").repartition(5), spark.createDataFrame(labels, LABELS).selectExpr("*", "1 as good"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 3 * 600 and set(rows) == brute(docs, labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in [*A.COUNTS, "shapley"]}


def test_empty_tables(spark):
    docs, labels = inputs(6)
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    assert {tuple(r) for r in A.audit(spark.createDataFrame(docs, DOCS), no_labels).collect()} == brute(docs, [])


def test_what_is_shuffled(spark):
    docs, labels = inputs(7)
    plan = A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("Generate explode")]
    assert "partial_sum" in before.split("Exchange")[-1]  # sums are taken where the steps are exploded
    assert "CartesianProduct" not in plan
