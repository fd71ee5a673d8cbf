"""Parsers as a table function, and a tree read by directories."""

from tessera.sources import extract as X


def test_a_parser_of_ones_own_and_one_that_fails(spark):
    def todo(text):
        for n, line in enumerate(text.split("\n"), 1):
            if "BOOM" in line:
                raise ValueError("boom")
            if line.startswith("-- todo "):
                yield "todo", n, line[8:]

    known = X.parsers() | {"sql": [todo]}
    X.register(spark, "facts_here", known, {"sql": ["sql", "ddl"]})
    files = [("a.sql", "select 1\n-- todo one"), ("b.ddl", "-- todo two\nBOOM\n-- todo three"), ("c.go", 'package c\nimport "fmt"'), ("d.py", "import os\ndef f():\n    import re"), ("e.ts", 'import x from "y"'), ("f.txt", "-- todo no"), ("g.sql", None), (None, "-- todo"), ("h.go", "")]
    spark.createDataFrame(files, "file string, text string").repartition(3).createOrReplaceTempView("texts_here")
    got = {(r.file, r.kind, r.line, r.subject) for r in spark.sql("SELECT file, f.* FROM texts_here, LATERAL facts_here(file, text) f").collect()}
    assert got == {
        ("a.sql", "todo", 2, "one"), ("b.ddl", "todo", 1, "two"), ("b.ddl", "problem", None, "ValueError: boom"), ("c.go", "import", 2, "fmt"), ("d.py", "import", 1, "os"), ("d.py", "import", 3, "re"),
        ("d.py", "lazy_import", 3, None), ("e.ts", "import", 1, "y"),
    }


def test_a_tree_is_read_by_directories(spark, tmp_path):
    texts = {"r.go": "package r", "a/x.py": "import os", "a/b/y.py": "", "a/b/c/d/z.go": 'import "fmt"', "e/f/g.txt": "é\r\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "a/raw.bin").write_bytes(b"\xff\xfe")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/config").write_text("x")
    (tmp_path / "a/link.py").symlink_to(tmp_path / "a/x.py")
    X.register(spark)
    tree = spark.read.format("code_tree").load(str(tmp_path))
    assert {r.file: r.text for r in tree.collect()} == texts | {"a/raw.bin": None}
    assert tree.rdd.getNumPartitions() == 5  # the root, a, e, a/b, e/f
    tree.createOrReplaceTempView("tree_here")
    got = spark.sql("SELECT file, f.subject FROM tree_here, LATERAL code_facts(file, text) f").collect()
    assert {tuple(r) for r in got} == {("a/x.py", "os"), ("a/b/c/d/z.go", "fmt")}
    (tmp_path / "none").mkdir()
    assert spark.read.format("code_tree").load(str(tmp_path / "none")).count() == 0
