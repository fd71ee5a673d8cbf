import datetime as dt
import random

from tessera.streaming import states as S

VERSIONS = "unit long, file string, module string, deleted boolean, literals array<struct<value: string, line: int>>"


def stream(spark, path, schema, operator, mode):
    """One run over what is new in path, with the state of the runs before."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = operator(source).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = query.format("parquet").start(f"{path}/out")
    else:
        query = query.foreachBatch(lambda df, k: df.selectExpr("*", f"{k} as batch").write.parquet(f"{path}/out", mode="append")).start()
    query.awaitTermination()


def test_index_takes_places_back(spark, tmp_path):
    """Edits, moves between modules, deletions and stale versions over two runs: the index is that of the last versions."""
    rng = random.Random(3)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    last: dict[str, tuple] = {}
    unit = 0
    seen: dict[str, tuple] = {}
    for run in range(2):
        for _ in range(2):
            rows = []
            for _ in range(40):
                unit += 1
                file = f"f{rng.randrange(8)}"
                row = (unit, file, f"m{rng.randrange(3)}", rng.random() < 0.2, [(f"v{rng.randrange(6)}", rng.randrange(1, 90)) for _ in range(rng.randrange(4))])
                rows.append(row)
                last[file] = row
            rows.append((1, rows[0][1], "m9", False, [("stale", 1)]) if run else (unit, "g", "m1", None, None))
            last.setdefault("g", (unit, "g", "m1", None, None))
            rng.shuffle(rows)
            spark.createDataFrame(rows, VERSIONS).coalesce(1).write.parquet(f"{a}/in", mode="append")
        stream(spark, a, VERSIONS, S.literal_changes, "append")
        new = spark.read.schema(S.CHANGES).parquet(f"{a}/out").where(f"unit > {0 if not run else 80}")
        new.coalesce(1).write.parquet(f"{b}/in", mode="append")
        stream(spark, b, S.CHANGES, S.literal_places, "update")
    for r in spark.read.parquet(f"{b}/out").orderBy("batch").collect():
        seen[r.value] = (r.places, r.modules, r.first_file, r.first_line)
    want: dict[str, dict] = {}
    for file, (_, _, module, deleted, literals) in last.items():
        for v, n in sorted([] if deleted else literals or [], key=lambda x: x[1]):
            want.setdefault(v, {}).setdefault(file, (module, n))
    held = {v: (len(p), len({m for m, _ in p.values()}), min(p), p[min(p)][1]) for v, p in want.items()}
    assert {v: s for v, s in seen.items() if s[0]} == held
    assert "stale" not in seen


def test_intervals_of_presence(spark, tmp_path):
    path = str(tmp_path)
    start = dt.datetime(2024, 1, 1, 12)
    day = (start.date() - dt.date(1970, 1, 1)).days
    there = {("x", "y"): [0, 1, 2, 4, 5, 9], ("x", "z"): [3], ("p", "q"): list(range(8))}
    batches = [[], [], [], []]
    for (a, b), days in there.items():
        for d in days:
            k = min(d // 3, 2)
            batches[k].append((start + dt.timedelta(days=d), a, b))
            batches[k].append((start + dt.timedelta(days=d, hours=3), a, b))  # twice on a day
    batches[1].append((start + dt.timedelta(days=2), "p", "q"))  # late, and known
    batches[3].append((start + dt.timedelta(days=60), "end", "end"))
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, a string, b string").coalesce(1).write.parquet(f"{path}/in", mode="append")
        stream(spark, path, "ts timestamp, a string, b string", S.presence, "append")
    stream(spark, path, "ts timestamp, a string, b string", S.presence, "append")
    got = sorted((r.a, r.b, r.opened - day, r.closed - day, r.units) for r in spark.read.schema(S.INTERVALS).parquet(f"{path}/out").collect())
    assert got == [("p", "q", 0, 7, 8), ("x", "y", 0, 2, 3), ("x", "y", 4, 5, 2), ("x", "y", 9, 9, 1), ("x", "z", 3, 3, 1)]
