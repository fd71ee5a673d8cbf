"""Facts from source files and manifests."""

from pyspark.sql import functions as F

from tessera.plans.reports import CLASSES
from tessera.sources import code


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in texts.items()], "file string, text string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_lazy(spark):
    py = "import a\ndef f():\n\timport b\n\n# c\nclass K:\n    import d\n    async def g(self):\n        from e import x\n    import h\nm = __import__('q'); importlib.import_module('r')\n"
    ts = "/* one\nrequire('a')\n*/ require('b')\nrequire ('c'); import('d')\n// import('e')\nmyrequire('f')\n/* x */ import('g')\nimport { h } from 'h'"
    d = spark.createDataFrame([("a.py", py), ("tests/a.py", py), ("b.tsx", ts), ("testdata/b.ts", ts), ("c.ts", None), ("d.go", ts)], "file string, text string")
    assert rows(code.dynamic_imports(d), "file", "line", "kind") == [("a.py", 3, "lazy_import"), ("a.py", 9, "lazy_import"), ("a.py", 11, "importlib"), ("b.tsx", 4, "dynamic_import"), ("b.tsx", 4, "require")]


def test_python_targets(spark):
    texts = {
        "src/p/__init__.py": "from . import a\nfrom .a import thing\n",
        "src/p/a.py": "import os, p.s.deep as d\nfrom .s import (\n  deep,\n  other,\n)\nfrom ... import x\nfrom .. import y\nfrom p import *\n",
        "src/p/s/__init__.py": "import p.gone\n", "src/p/s.py": "import json\n", "src/p/s/deep.py": "from ..a import k\nprint 'old'\nfrom . import (deep, # it\n  zz)\n", "q/b.py": "import p\n",
    }
    d = spark.createDataFrame(list(texts.items()), "file string, text string")
    modules = code.python_modules(d, ["p"])
    assert rows(modules, "module", "file") == [("p", "src/p/__init__.py"), ("p.a", "src/p/a.py"), ("p.s", "src/p/s/__init__.py"), ("p.s.deep", "src/p/s/deep.py")]
    got = code.python_targets(code.python_imports(d), modules).fillna("", ["target"])
    want = {
        ("src/p/__init__.py", 1, "p.a", "file"), ("src/p/__init__.py", 2, "p.a", "file"), ("src/p/a.py", 1, "os", "external"), ("src/p/a.py", 1, "p.s.deep", "file"), ("src/p/a.py", 3, "p.s.deep", "file"),
        ("src/p/a.py", 4, "p.s", "file"), ("src/p/a.py", 6, "...", "unknown"), ("src/p/a.py", 7, "..", "unknown"), ("src/p/a.py", 8, "p", "file"), ("src/p/s/__init__.py", 1, "p.gone", "unknown"),
        ("src/p/s/deep.py", 1, "p.a", "file"), ("src/p/s/deep.py", 3, "p.s.deep", "file"), ("src/p/s/deep.py", 4, "p.s", "file"),
    }
    assert set(rows(got, "file", "line", "module", "kind")) == want


def test_manifests(spark):
    mod = "module m\nretract v1.0.0 // oops // twice\nretract [v1.1.0, v1.2.0]\nretract (\n  // note\n  v2.0.0\n\n  v2.0.1 // bad\n)\nretract\n"
    d = spark.createDataFrame([("go.mod", mod), ("x/go.mod", None), ("a/other.mod", mod)], "file string, text string")
    assert rows(code.retractions(d), "file", "subject", "note") == [("go.mod", "[v1.1.0, v1.2.0]", ""), ("go.mod", "v1.0.0", "oops // twice"), ("go.mod", "v2.0.0", ""), ("go.mod", "v2.0.1", "bad")]
    said = ['{"name":"n","deprecated":"use m"}', '{"deprecated":"use k"}', '{"deprecated":true}', '{"deprecated":""}', "{", None, '{"name":3,"deprecated":"z"}']
    d = spark.createDataFrame([(f"{i}/package.json", t) for i, t in enumerate(said)], "file string, text string")
    assert rows(code.deprecated(d), "file", "note")[:2] == [("0/package.json", "use m"), ("1/package.json", "use k")]
    assert rows(code.deprecated(d), "file") == [("0/package.json",), ("1/package.json",), ("6/package.json",)]


def test_classes(spark):
    d = spark.createDataFrame([(p.format(7), c) for p, c in CLASSES], "path string, want string").withColumn("got", code.file_class(F.col("path"), F.lit("x"), ["custom/**"], ["e2e/"]))
    assert d.where("got <> want").collect() == []


def test_attested(spark):
    import hashlib

    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two")}
    now = spark.createDataFrame([("a", "one"), ("b", "two"), ("n", None)], "file string, text string")
    cases = {"ok": [("a", sha["one"])], "other": [("a", sha["two"])], "gone": [("a", sha["one"]), ("z", sha["one"])], "odd": [("a", sha["one"].upper())], "old": [("a", sha["one"])], "none": [], "unread": [("a", sha["one"])], "more": [("b", sha["two"])]}
    sidecars = spark.createDataFrame([(k, "0" if k == "old" else "1") for k in cases], "report string, schema string")
    named = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v], "report string, file string, digest string")
    facts = spark.createDataFrame([(k, "a") for k in (*cases, "bare") if k != "unread"], "report string, file string")
    got = dict(rows(code.attested(sidecars, named, now, facts), "report", "freshness"))
    assert got == {"ok": "matched", "other": "stale", "gone": "stale", "more": "stale"} | dict.fromkeys(["odd", "old", "none", "unread", "bare"], "unverified")


def test_texts_that_do_not_parse(spark):
    text = '"""Doc\nimport no\n"""\nimport a  # import b\nx = "from c import d"\ndef f(:\n    \'\'\'from e import f\n    import g\n\'\'\'\n    from .h import (i,\n        j)\n'
    df = spark.createDataFrame([("x.py", text), ("y.py", "import fine"), ("z.go", "import (")], "file string, text string")
    assert sorted((r.file, r.line, r.base, r.name) for r in code.python_imports(df).collect()) == [("x.py", 4, None, "a"), ("x.py", 10, ".h", "i"), ("x.py", 11, ".h", "j"), ("y.py", 1, None, "fine")]
    assert [(r.file, r.line) for r in code.python_problems(df).collect()] == [("x.py", 6)]
