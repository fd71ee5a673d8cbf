"""Coverage reports of five formats as facts.

reports: (report, path, text), one row a report.  A report is read whole or not at all: `facts` gives (report, format,
file, covered, total, unit) of sound reports, `problems` gives (report, problem) of the others.  Null and blank texts are
`ambiguous`: their content names no format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Formats by extension, and the record names of a tracefile.
BY_EXTENSION = {"coverprofile": ["go"], "cover": ["go"], "out": ["go"], "info": ["lcov"], "lcov": ["lcov"], "json": ["coverage_py", "llvm_cov"], "xml": ["cobertura"]}
RECORDS = ["TN", "SF", "DA", "LF", "LH", "FN", "FNDA", "FNF", "FNH", "BRDA", "BRF", "BRH", "end_of_record"]
BLOCK = r"^(.+):([0-9]+)\.([0-9]+),([0-9]+)\.([0-9]+) ([0-9]+) ([0-9]+)$"
FACT = ["report", "format", "file", "covered", "total", "unit"]

PY = "files map<string, struct<summary: struct<covered_lines: bigint, missing_lines: bigint>>>"
LLVM = "data array<struct<files: array<struct<filename: string, summary: struct<lines: struct<covered: bigint, count: bigint>>>>>>"
_LINES = "struct<line: array<struct<_number: bigint, _hits: bigint>>>"
_CLASS = f"struct<_filename: string, lines: {_LINES}, methods: struct<method: array<struct<lines: {_LINES}>>>>"
COBERTURA = f"sources struct<source: array<string>>, packages struct<package: array<struct<classes: struct<class: array<{_CLASS}>>>>>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: What the content of a format starts with.
STARTS = {"go": "^mode:", "lcov": "^(?:TN|SF):", "coverage_py": r"^\{", "llvm_cov": r"^\{", "cobertura": "^<"}
_ROOT = r"^(?:<\?[^>]*>\s*|<!--[\s\S]*?-->\s*|<![^>]*>\s*)*<(?:\w+:)?coverage[\s/>]"


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _body(text: Column) -> Column:
    return _trim(F.regexp_replace(text, r"^\x{FEFF}", ""))


def detect(path: Column, text: Column) -> Column:
    """The one format that extension and content allow; null where none or several are left."""
    none = F.array().cast("array<string>")
    ext, body = _ext(path), _body(text)
    named = reduce(lambda c, k: c.when(ext == k, F.array(*map(F.lit, BY_EXTENSION[k]))), BY_EXTENSION, F.when(F.lit(False), F.array(F.lit("")))).otherwise(none)
    py = F.coalesce(F.size(F.map_keys(F.from_json(body, PY)["files"])) > 0, F.lit(False))
    llvm = F.coalesce(F.size(F.from_json(body, LLVM)["data"]) > 0, F.lit(False))
    shown = (
        F.when(body.rlike(_ROOT), F.array(F.lit("cobertura"))).when(body.rlike(STARTS["go"]), F.array(F.lit("go"))).when(body.rlike(STARTS["lcov"]), F.array(F.lit("lcov")))
        .when(body.rlike(STARTS["llvm_cov"]), F.filter(F.array(F.when(py, "coverage_py"), F.when(llvm, "llvm_cov")), lambda x: x.isNotNull())).otherwise(none)
    )

    def one(x):
        left = F.when(F.size(x["named"]) == 0, x["shown"]).when(F.size(x["shown"]) == 0, x["named"]).otherwise(F.array_intersect(x["named"], x["shown"]))
        return F.transform(F.array(left), lambda y: F.when(F.size(y) == 1, y[0]))[0]

    # bound once: an expression of its parts would parse the text for each
    return F.transform(F.array(F.struct(named.alias("named"), F.coalesce(shown, none).alias("shown"))), one)[0]


def _rows(reports: DataFrame) -> DataFrame:
    """(report, at, content) of lines that are not blank."""
    rows = reports.select("report", F.posexplode(F.split("text", "\r?\n")).alias("at", "content"))
    return rows.where(~F.col("content").rlike(r"^\s*$"))


def _merged(rows: DataFrame, fmt: str) -> DataFrame:
    """Line records (report, file, at, hits, bad) to facts; the most hits of a line count.  file is null in a row that only tells."""
    by = rows.groupBy("report", "file", "at").agg(F.max("hits").alias("hits"), F.max("bad").alias("bad"))
    by = by.groupBy("report", "file").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count_if(F.col("at").isNotNull()).alias("total"), F.max("bad").alias("bad"))
    return by.select("report", F.lit(fmt).alias("format"), "file", "covered", "total", F.lit("lines").alias("unit"), "bad")


def _go(reports: DataFrame) -> DataFrame:
    first = Window.partitionBy("report").orderBy("at")
    rows = _rows(reports).select("report", _trim(F.col("content")).alias("content"), (F.row_number().over(first) == 1).alias("head"))
    part = [F.regexp_extract("content", BLOCK, k).try_cast("bigint") for k in range(2, 8)]
    sound = reduce(lambda a, b: a & b, [F.coalesce(x > 0, F.lit(False)) for x in part[:5]]) & part[5].isNotNull()
    bad = F.when(F.col("head"), ~F.col("content").rlike(r"^mode:\s*(?:set|count|atomic)$")).otherwise(~sound)
    rows = rows.select("report", F.when(~F.col("head"), F.regexp_extract("content", BLOCK, 1)).alias("file"), part[4].alias("n"), part[5].alias("hits"), bad.cast("int").alias("bad"))
    by = rows.groupBy("report", "file").agg(F.coalesce(F.sum(F.when(F.col("hits") > 0, F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.max("bad").alias("bad"))
    return by.select("report", F.lit("go").alias("format"), "file", "covered", "total", F.lit("statements").alias("unit"), "bad")


def _lcov(reports: DataFrame) -> DataFrame:
    seen = Window.partitionBy("report").orderBy("at")
    whole = Window.partitionBy("report")
    key, value = F.substring_index("content", ":", 1), F.expr("substring(content, instr(content, ':') + 1)")
    rows = _rows(reports).select("report", "at", key.alias("key"), F.when(F.col("content").contains(":"), value).alias("value"))
    opens, ends = (F.col("key") == "SF").cast("int"), (F.col("key") == "end_of_record").cast("int")
    rows = rows.withColumn("rec", F.sum(opens).over(seen)).withColumn("open", F.col("rec") - F.sum(ends).over(seen) + ends)
    parts = F.split("value", ",")
    rows = rows.withColumn("line", F.when(F.col("key") == "DA", F.trim(parts[0]).try_cast("bigint"))).withColumn("hits", F.when(F.col("key") == "DA", F.trim(parts[1]).try_cast("bigint")))
    da = F.coalesce(F.col("line") > 0, F.lit(False)) & F.coalesce(F.col("hits") >= 0, F.lit(False)) & (F.size(parts) <= 3) & ((F.size(parts) < 3) | (F.trim(F.get(parts, F.lit(2))) != ""))
    held = F.count("line").over(Window.partitionBy("report", "rec"))
    sound = (
        F.when(F.col("key") == "TN", F.col("value").isNotNull())
        .when(F.col("key") == "SF", (F.col("open") == 1) & (F.trim("value") != ""))
        .when(F.col("key") == "end_of_record", (F.col("open") == 1) & (held > 0) & (F.coalesce("value", F.lit("")) == ""))
        .when(F.col("key") == "DA", (F.col("open") == 1) & da)
        .when(F.col("key").isin("LF", "LH"), (F.col("open") == 1) & (F.coalesce(F.trim("value").try_cast("bigint"), F.lit(-1)) >= 0))
        .otherwise((F.col("open") == 1) & F.col("value").isNotNull() & F.col("key").isin(*RECORDS))
    )
    torn = F.sum(opens).over(whole) != F.sum(ends).over(whole)
    source = F.first(F.when(F.col("key") == "SF", F.trim("value")), True).over(Window.partitionBy("report", "rec"))
    rows = rows.select("report", source.alias("file"), F.col("line").alias("at"), "hits", (~F.coalesce(sound, F.lit(False)) | torn).cast("int").alias("bad"))
    return _merged(rows, "lcov")


def _coverage_py(reports: DataFrame) -> DataFrame:
    files = F.from_json("text", PY)["files"]
    rows = reports.select("report", F.explode_outer(files).alias("file", "f")).select("report", "file", F.col("f.summary.covered_lines").alias("c"), F.col("f.summary.missing_lines").alias("m"))
    sound = (F.trim("file") != "") & (F.col("c") >= 0) & (F.col("m") >= 0)
    return rows.select("report", F.lit("coverage_py").alias("format"), "file", F.col("c").alias("covered"), (F.col("c") + F.col("m")).alias("total"), F.lit("lines").alias("unit"), (~F.coalesce(sound, F.lit(False))).cast("int").alias("bad"))


def _llvm_cov(reports: DataFrame) -> DataFrame:
    rows = reports.select("report", F.explode_outer(F.from_json("text", LLVM)["data"]).alias("d")).select("report", F.explode_outer("d.files").alias("f"))
    rows = rows.select("report", F.trim("f.filename").alias("file"), F.col("f.summary.lines.covered").alias("c"), F.col("f.summary.lines.count").alias("n"))
    sound = F.coalesce((F.col("file") != "") & (F.col("c") >= 0) & (F.col("c") <= F.col("n")), F.lit(False))
    by = rows.groupBy("report", "file").agg(F.max("c").alias("covered"), F.max("n").alias("total"), F.max((~sound).cast("int")).alias("bad"), F.min("n").alias("least"))
    bad = F.when(F.col("least") != F.col("total"), 1).otherwise(F.col("bad"))
    return by.select("report", F.lit("llvm_cov").alias("format"), "file", "covered", "total", F.lit("lines").alias("unit"), bad.alias("bad"))


def _cobertura(reports: DataFrame) -> DataFrame:
    doc = reports.select("report", F.from_xml(F.regexp_replace("text", r"^\x{FEFF}", ""), COBERTURA, {"mode": "PERMISSIVE"}).alias("d"))
    rows = doc.select("report", F.get("d.sources.source", F.lit(0)).alias("root"), F.explode_outer("d.packages.package").alias("p")).select("report", "root", F.explode_outer("p.classes.class").alias("c"))
    none = F.array().cast("array<struct<_number: bigint, _hits: bigint>>")
    inner = F.flatten(F.transform(F.coalesce("c.methods.method", F.array().cast(f"array<struct<lines: {_LINES}>>")), lambda m: F.coalesce(m["lines"]["line"], none)))
    name = F.replace(F.trim("c._filename"), F.lit("\\"), F.lit("/"))
    root = F.regexp_replace(F.replace(_trim(F.col("root")), F.lit("\\"), F.lit("/")), "/+$", "")
    file = F.when(root.isNull() | (root == "") | name.startswith("/"), name).otherwise(F.concat(root, F.lit("/"), name))
    rows = rows.select("report", "c", file.alias("file"), F.explode_outer(F.concat(F.coalesce("c.lines.line", none), inner)).alias("l"))
    line = F.col("l").isNull() | F.coalesce((F.col("l._number") > 0) & (F.col("l._hits") >= 0), F.lit(False))
    bad = ~(F.coalesce(F.trim("c._filename") != "", F.lit(False)) & line)
    return _merged(rows.select("report", "file", F.col("l._number").alias("at"), F.col("l._hits").alias("hits"), bad.cast("int").alias("bad")), "cobertura")


PARSERS = {"go": _go, "lcov": _lcov, "coverage_py": _coverage_py, "llvm_cov": _llvm_cov, "cobertura": _cobertura}


def _parsed(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports with their format, and the rows of each parser.

    The texts are written as they come, so that no condition on them makes them anew, and then by format, so that a parser reads its own reports alone."""
    given = cut(reports.select("report", "path", "text"), "coverage-texts")
    known = cut(given.select("report", "text", detect(F.col("path"), F.col("text")).alias("format")), "coverage-reports", by="format")
    rows = [parse(known.where(F.col("format") == name).select("report", "text")) for name, parse in PARSERS.items()]
    return known.select("report", "format"), reduce(DataFrame.unionByName, rows)


def facts(reports: DataFrame) -> DataFrame:
    """(report, format, file, covered, total, unit) of the reports that are sound throughout."""
    _, rows = _parsed(reports)
    bad = F.max("bad").over(Window.partitionBy("report"))
    return rows.withColumn("bad", bad).where("bad = 0 AND file IS NOT NULL").select(*FACT)


def problems(reports: DataFrame) -> DataFrame:
    """(report, problem): `ambiguous` where no format or several fit, `malformed` where a record is wrong or there is none."""
    known, rows = _parsed(reports)
    state = rows.groupBy("report").agg(F.max("bad").alias("bad"), F.count("file").alias("n"))
    out = known.select("report", "format").join(state, "report", "left")
    problem = F.when(F.col("format").isNull(), "ambiguous").when(F.coalesce("bad", F.lit(1)).eqNullSafe(1) | (F.col("n") == 0), "malformed")
    return out.select("report", problem.alias("problem")).where("problem IS NOT NULL")
