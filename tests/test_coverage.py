"""Coverage reports: every format, wrong records, detection."""

import json

from tessera.sources import coverage

LCOV = "TN:\nSF:a.go\nDA:1,2\nDA:2,0\nDA:2,0,x\nLF:2\nend_of_record\nSF:a.go\nDA:2,1\nend_of_record\nSF:b.go\nDA:7,0\nend_of_record\n"
GO = "mode: set\nm/a.go:1.1,2.3 4 1\nm/a.go:5.1,6.3 2 0\n\nm/b.go:1.1,2.2 3 9\n"
PY = json.dumps({"meta": {"v": 1}, "files": {"a.py": {"summary": {"covered_lines": 3, "missing_lines": 1, "other": 2}}}})
LLVM = json.dumps({"data": [{"files": [{"filename": "x.rs", "summary": {"lines": {"covered": 1, "count": 4}}}, {"filename": "x.rs", "summary": {"lines": {"covered": 2, "count": 4}}}]}]})
XML = '<?xml version="1.0"?>\n<!DOCTYPE coverage SYSTEM "x">\n<coverage><sources><source>/r</source></sources><packages><package><classes><class filename="a.py"><methods><method><lines><line number="3" hits="0"/></lines></method></methods><lines><line number="3" hits="4"/><line number="4" hits="0"/></lines></class></classes></package></packages></coverage>'
BAD = {
    "no end": ("x.info", "SF:a\nDA:1,1\n"),
    "no data": ("x.info", "SF:a\nend_of_record\n"),
    "outside": ("x.info", "DA:1,1\nSF:a\nDA:1,1\nend_of_record\n"),
    "nested": ("x.info", "SF:a\nDA:1,1\nSF:b\nDA:1,1\nend_of_record\nend_of_record\n"),
    "unknown": ("x.info", "SF:a\nDA:1,1\nXX:1\nend_of_record\n"),
    "line zero": ("x.info", "SF:a\nDA:0,1\nend_of_record\n"),
    "mode": ("x.out", "mode: odd\na:1.1,2.2 1 1\n"),
    "no mode": ("x.out", "a:1.1,2.2 1 1\n"),
    "block": ("x.out", "mode: set\na:1.1,2.2 1\n"),
    "only mode": ("x.out", "mode: set\n"),
    "conflict": ("x.json", LLVM.replace('"count": 4}}}]', '"count": 5}}}]')),
    "incomplete": ("x.json", LLVM.replace('"covered": 1, ', "")),
    "nameless": ("x.xml", XML.replace("a.py", "")),
    "hits": ("x.xml", XML.replace('hits="4"', 'hits="-4"')),
}
ODD = {"none": ("x", "hello"), "null": ("x", None), "clash": ("x.xml", GO), "empty": ("", "")}


def test_facts_and_problems(spark):
    good = {"lcov": ("c.info", LCOV), "go": ("c.out", GO), "py": ("c.json", PY), "llvm": ("c", LLVM), "xml": ("c.xml", XML)}
    rows = [(k, *v) for k, v in (good | BAD | ODD).items()]
    reports = spark.createDataFrame(rows, "report string, path string, text string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in coverage.facts(reports).collect())
    assert got == [
        ("go", "m/a.go", 4, 6, "statements"), ("go", "m/b.go", 3, 3, "statements"), ("lcov", "a.go", 2, 2, "lines"), ("lcov", "b.go", 0, 1, "lines"),
        ("llvm", "x.rs", 2, 4, "lines"), ("py", "a.py", 3, 4, "lines"), ("xml", "/r/a.py", 1, 2, "lines"),
    ]
    found = {r["report"]: r["problem"] for r in coverage.problems(reports).collect()}
    assert found == dict.fromkeys(BAD, "malformed") | dict.fromkeys(ODD, "ambiguous")


def test_no_reports(spark):
    empty = spark.createDataFrame([], "report string, path string, text string")
    assert coverage.facts(empty).count() == 0 and coverage.problems(empty).count() == 0


def test_texts_are_made_once(spark):
    """Parsers read written texts: no plan makes a report's text again for each format."""
    reports = spark.range(3).selectExpr("id AS report", "'a.info' AS path", "concat('SF:f', id, '\nDA:1,1\nend_of_record\n') AS text")
    got = coverage.facts(reports)
    assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.report, r.file, r.covered, r.total) for r in got.collect()) == [(k, f"f{k}", 1, 1) for k in range(3)]
