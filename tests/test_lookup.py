from pyspark.sql import functions as F

from tessera.sources import lookup
from tessera.sources.code import scanned


def test_keys_that_many_rows_share(spark, monkeypatch):
    """Same values as a left join, but no task has all rows of a key."""
    monkeypatch.setattr(lookup, "HEAVY", 2)
    rows = spark.range(400).selectExpr("id", "CASE WHEN id < 300 THEN 'hot' WHEN id < 350 THEN 'none' WHEN id < 360 THEN NULL ELSE concat('k', id) END AS key")
    known = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(360, 390))], "key string, v long")
    got = lookup.looked_up(rows, known, "key", "v")
    want = {r.id: r.v for r in rows.join(known, "key", "left").collect()}
    assert {r.id: r.v for r in got.collect()} == want and got.count() == 400
    monkeypatch.setattr(lookup, "HEAVY", 2)
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in lookup.looked_up(rows, known, "key", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 120


def test_rows_are_handed_on_in_parts(spark):
    """A batch of texts that holds many facts is no one record batch, and one pass takes several languages."""
    d = spark.createDataFrame([("a.py", "x"), ("b.go", "y"), ("c.txt", "z"), ("d.py", None)], "file string, text string").coalesce(1)
    out = scanned(d, "line bigint", {"python": lambda t: ((i,) for i in range(20_000)), "go": lambda t: [(7,)]})
    assert sorted((r["file"], r["count"]) for r in out.groupBy("file").count().collect()) == [("a.py", 20_000), ("b.go", 1)]
    sizes = out.select("file").mapInArrow(lambda bs: (b.slice(0, 1) for b in bs if b.num_rows), "file string").count()
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1 and sizes >= 1
