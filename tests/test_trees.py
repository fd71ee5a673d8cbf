import random

from tessera.sources import trees as T


def test_changes_are_those_of_the_file_lists(spark):
    rng = random.Random(2)
    before = {f"d{rng.randrange(4)}/e{rng.randrange(3)}/f{k}": f"x{rng.randrange(30)}" for k in range(60)} | {"top": "t", "d0/same": "s", "solo/deep/er/one": "only"}
    after = dict(before)
    for k in sorted(before)[::7]:
        after[k] = "changed" + k
    for k in sorted(before)[3::9]:
        after.pop(k)
    after["d9/new/n"] = "new"
    after["elsewhere/one"] = after.pop("solo/deep/er/one", "only")
    after["top/now/dir"] = "dir"  # a file gives way to a directory
    after.pop("top", None)
    a, b = (T.tree(spark.createDataFrame(list(x.items()), "file string, digest string").repartition(3)) for x in (before, after))
    got = {(r.file, r.change, r.old_file) for r in T.compare(a, b).collect()}
    removed, added = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    want = {(f, "changed", None) for f in before.keys() & after.keys() if before[f] != after[f]}
    for digest in {before[f] for f in removed} | {after[f] for f in added}:
        r, d = [f for f in removed if before[f] == digest], [f for f in added if after[f] == digest]
        if len(r) == len(d):
            want |= {(y, "renamed", x) for x, y in zip(r, d)}
        else:
            want |= {(x, "removed", None) for x in r} | {(y, "added", None) for y in d}
    assert got == want
    assert T.compare(a, a).count() == 0


def test_only_directories_that_differ_are_opened(spark, monkeypatch):
    before = [(f"a{i}/b{j}/f{k}", "x") for i in range(10) for j in range(10) for k in range(5)]
    after = [(f, "y" if f == "a3/b4/f2" else d) for f, d in before]
    a, b = (T.tree(spark.createDataFrame(x, "file string, digest string")) for x in (before, after))
    rows = []
    real = T.cut
    monkeypatch.setattr(T, "cut", lambda df, name: rows.append((name, real(df, name))) or rows[-1][1])
    assert [tuple(r) for r in T.compare(a, b).collect()] == [("a3/b4/f2", "changed", None)]
    assert [d.count() for name, d in rows if name == "open"] == [1, 1, 0]


def test_below(spark):
    files = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "file string")
    assert sorted(r.file for r in T.below(files, spark.createDataFrame([("a/b",), ("x",)], "dir string")).collect()) == ["a/b/c", "x"]
