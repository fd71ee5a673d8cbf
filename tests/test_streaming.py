import datetime as dt

from tessera import streaming as S


def run(spark, df, path, operator, mode):
    for n, part in enumerate(df.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.parquet(f"{path}/in", mode="append")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = operator(source).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("out").collect()


def test_running_literal_index_is_the_batch_index(spark, tmp_path):
    df = spark.createDataFrame([(f"v{i % 7}", f"m{i % 3}", f"f{i}") for i in range(60)], "value string, module string, file string")
    got = run(spark, df, str(tmp_path), S.literal_index, "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.literal_index(df).collect()))


def test_pairs_appear_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=i), f"a{i % 4}", f"b{i % 2}") for i in range(40)], "ts timestamp, `from` string, `to` string")
    got = run(spark, df, str(tmp_path), S.first_appearances, "append")
    assert sorted((r["from"], r["to"]) for r in got) == [("a0", "b0"), ("a1", "b1"), ("a2", "b0"), ("a3", "b1")]


def test_edits_by_window(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=7 * i), f"f{i % 2}", i) for i in range(40)], "ts timestamp, file string, added long")
    got = run(spark, df, str(tmp_path), S.edits, "update")
    last = {}
    for r in got:
        last[(r.window.start, r.file)] = max(last.get((r.window.start, r.file), (0, 0)), (r.edits, r.added))
    want = {(r.window.start, r.file): (r.edits, r.added) for r in S.edits(df).collect()}
    assert last == want
