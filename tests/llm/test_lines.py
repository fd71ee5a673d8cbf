import random

from tessera.llm import lines as Q

BLANK = " \t\n\v\f\r"


def brute(rows, t=Q.SIMILARITY, k=Q.SHINGLE):
    lines = {}
    docs = sorted({(i, x) for i, x in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, x in docs:
        for at, line in enumerate(x.split("\n") if x is not None else []):
            if line.strip(BLANK):
                lines.setdefault(line, []).append((i, x, at))
    names = list(lines)
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in names]
    up = list(range(len(names)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n >= t * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    first = {}
    for a, x in enumerate(names):
        first.setdefault(find(a), []).extend(lines[x])
    keep = {min(v, key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for v in first.values()}
    out = []
    for i, x in rows:
        if x is None:
            out.append((i, None, 0, 0))
            continue
        parts = x.split("\n")
        kept = [p for at, p in enumerate(parts) if not p.strip(BLANK) or (i, x, at) in keep]
        out.append((i, "\n".join(kept), len(parts), len(kept)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghéü") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)]

    def edit(x):
        w = x.split(" ")
        w[rng.randrange(len(w))] = word()
        return " ".join(w)

    rows = []
    for i in range(150):
        parts = [rng.choice(base) if rng.random() < 0.5 else edit(rng.choice(base)) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(parts + [""] * rng.randint(0, 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as line", "3 as n_kept", "4 as root", "5 as at").repartition(5)
    out = Q.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "id", "line", "n_kept", "root", "at", "n_lines"}
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect())
    want = sorted(brute(rows))
    differ = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(differ) <= 1  # recall of the bands is 0.999 at the threshold


def test_odd_texts(spark):
    line = "the quick brown fox jumps over the lazy dog"
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, line + "\n" + line), (6, line), (6, line), (None, line), (7, "x" * 100_000), (8, "y\n\n \nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in Q.dedup_lines(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert Q.dedup_lines(df.limit(0)).count() == 0


def test_repetitive_lines_of_different_lengths(spark):
    sentence = "".join(random.Random(8).choice("abcdefghij klmnop") for _ in range(150))
    rows = [(1, sentence), (2, sentence + sentence), (3, "=" * 100), (4, "=" * 300), (5, "=" * 400), (6, "-+" * 90 + "\n" + "-+" * 700)]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_kept) for r in Q.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))
    assert [r[3] for r in got] == [1, 0, 1, 0, 0, 1]


def test_short_copies_collapse_in_the_query_and_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tessera.llm.queries import op8_lines

    rows = [(1, "Les.\n\nWh the.\nLes."), (2, "Les.\n \n\nles."), (3, "été\nWh the."), (4, "the quick brown fox jumps\nété")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_kept) for r in op8_lines(spark, str(tmp_path)).collect()}
    assert got == {1: ("Les.\n\nWh the.", 4, 3), 2: (" \n\nles.", 4, 3), 3: ("été", 2, 1), 4: ("the quick brown fox jumps", 2, 1)}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {i: t for i, (t, _, _) in got.items()}


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 in short, normal, long and very long lines."""
    rng = random.Random(12)

    def shingles(x):
        return {x[i : i + Q.SHINGLE] for i in range(len(x) - Q.SHINGLE + 1)}

    def line(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    for low, high in ((45, 90), (100, 190), (195, 330), (400, 900), (1500, 4000)):
        rows, pairs = [], 0
        while pairs < 300:
            x = line(rng.randint(low, high))
            y, a = x, shingles(x)
            while True:
                at = rng.randrange(len(y))
                y = y[:at] + rng.choice("0123456789") + y[at + 1 :]
                b = shingles(y)
                j = len(a & b) / len(a | b)
                if j < 0.85:
                    break
            if j >= 0.8:
                rows += [(2 * pairs, x), (2 * pairs + 1, y)]
                pairs += 1
        out = Q.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert out.where("n_kept = 0").count() >= 0.985 * pairs


def test_a_group_around_one_line_and_a_chain(spark):
    """Copies that are like the first line alone, and links that lead from copy to copy."""
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefghijklm nopq") for _ in range(300))

    def edit(x, k):
        for _ in range(k):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice("0123456789") + x[at + 1 :]
        return x

    chain = [base[::-1]]
    for _ in range(12):
        chain.append(edit(chain[-1], 2))
    rows = [(i, x) for i, x in enumerate([base] + [edit(base, 3) for _ in range(150)] + chain)]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_kept) for r in Q.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted(brute(rows))
    assert sum(a != b for a, b in zip(got, want)) <= 1


def test_shingles_by_place_and_bits_once(spark):
    """Shingles are those of the line's code points, and the bits of a hash are reckoned once, not for each word of a sketch or bitmap."""
    from pyspark.sql import functions as F

    lines = ["", "a", "1234567", "12345678", "123456789", "é😀" * 9, "x" * 50, "the quick brown fox jumps"]
    parts = [(i, x[k : k + Q.SHINGLE]) for i, x in enumerate(lines) for k in range(max(1, len(x) - Q.SHINGLE + 1))]
    want = {r.id: set(r.h) for r in spark.createDataFrame(parts, "id long, s string").groupBy("id").agg(F.collect_set(F.xxhash64(F.encode("s", "UTF-32"))).alias("h")).collect()}
    d = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {r.id: r.h for r in d.select("id", Q.shingles(F.col("line")).alias("h")).collect()}
    assert {i: set(h) for i, h in got.items()} == want and all(len(h) == len(set(h)) for h in got.values())
    sketch = {r.id: r for r in Q.sketches(d).collect()}
    for i, hashes in want.items():
        words = [0] * Q.WORDS
        for h in hashes:
            h &= (1 << 64) - 1
            words[(h >> 30) & (Q.WORDS - 1)] ^= 1 << ((h >> 50) & 63)
        assert sketch[i].n == len(hashes) and [sketch[i][f"x{j}"] & ((1 << 64) - 1) for j in range(Q.WORDS)] == words
    hashed = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 4)], "id long, level int, i int, h long")
    for out in (Q.sketches(d), Q.minima(hashed, Q.MASKS)):
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("shiftrightunsigned") <= 2


def test_work_on_lines_is_done_once(spark):
    """Blank lines are told without a pattern, a hash is taken once for the filter and the minima, and a set once for its sketch."""
    from pyspark.sql import functions as F

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    lines = ["", BLANK.replace("\n", ""), "\x1c", "\u00a0", " \u2003", "\t a", "b \r", "é😀"]
    found = Q.split_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string"))
    assert "rlike" not in plan(found)
    assert sorted(r.line for r in found.collect()) == sorted(x for x in lines if x.strip(BLANK))
    places = spark.createDataFrame([(level, level, (1 << 2 * level) - 1, i, f"{i}") for level in (0, 1, 2) for i in range(64)], "id long, level int, zeros long, i int, s string")
    some = Q.sampled(places.withColumn("h", F.xxhash64("s")))
    assert plan(Q.minima(some, Q.MASKS)).count("xxhash64") == 1
    hashes = {r.i: r.h for r in places.where("level = 0").select("i", F.xxhash64("s").alias("h")).collect()}
    got = {r.id: r for r in Q.minima(some, Q.MASKS).collect()}
    for level in (0, 1, 2):
        sample = [h for h in hashes.values() if h % (1 << 2 * level) == 0]
        assert got[level].taken == len(sample) and got[level].lines == 1
        assert [got[level][f"m{k}"] for k in range(len(Q.MASKS))] == [min(h ^ m for h in sample) for m in Q.MASKS]
    sketch = Q.sketches(spark.createDataFrame([(1, "a" * 50), (2, "b")], "id long, line string"))
    assert plan(sketch).count("xxhash64") == 1 and {r.id: r.n for r in sketch.collect()} == {1: 1, 2: 1}
