"""Policy files as rows: what they say, with defaults filled in, and what is wrong with them.

``document.values`` gives every value with its keys; a value's pattern is its keys
with names and places left out, so the schema is a table that values are joined
with.  All files go through one plan; what later steps read more than once is written.  ``problems`` are (policy, path, problem);
``rows`` are those that ``operators.policy`` takes, of files without a problem.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

VERSION = "3"
#: The schema: kinds by pattern, * for a name and [] for a place in a list (fixed values).
SCHEMA = {
    "": "map", "version": "int", "owners": "list", "owners[]": "string", "gate": "string", "layers": "list", "layers[]": "string", "modules": "map", "modules.*": "map",
    "modules.*.paths": "list", "modules.*.paths[]": "string", "modules.*.public": "list", "modules.*.public[]": "string", "modules.*.volatility": "string",
    "modules.*.subdomain": "string", "modules.*.layer": "string", "modules.*.depends_on": "list", "modules.*.depends_on[]": "string",
    "builtin": "map", "builtin.graph": "string", "builtin.coupling": "string", "builtin.duplication": "string", "builtin.cycle": "string", "builtin.layers": "string",
    "builtin.unowned": "string", "builtin.min_balance": "int", "rules": "list", "rules[]": "map", "rules[].id": "string", "rules[].deny": "map", "rules[].deny.from": "names",
    "rules[].deny.from[]": "string", "rules[].deny.to": "names", "rules[].deny.to[]": "string", "rules[].only": "map", "rules[].only.use": "string", "rules[].only.in": "names",
    "rules[].only.in[]": "string", "rules[].note": "string", "rules[].why": "string", "rules[].instead": "string", "exceptions": "list", "exceptions[]": "map",
    "exceptions[].rule": "string", "exceptions[].from": "string", "exceptions[].to": "string", "exceptions[].expires": "string", "exceptions[].why": "string",
    "generated": "list", "generated[]": "string", "tests": "list", "tests[]": "string", "exclude": "list", "exclude[]": "string",
    "languages": "map", "languages.go": "map", "languages.go.enabled": "switch", "languages.go.modules": "map", "languages.go.modules.include": "list", "languages.go.modules.include[]": "string",
    "languages.go.modules.exclude": "list", "languages.go.modules.exclude[]": "string", "languages.typescript": "map", "languages.typescript.enabled": "switch", "languages.python": "map",
    "languages.python.enabled": "switch", "languages.python.package": "string", "languages.rust": "map", "languages.rust.enabled": "switch", "languages.rust.manifest": "string",
    "languages.rust.features": "list", "languages.rust.features[]": "string", "languages.rust.include_dev_deps": "bool", "languages.dotnet": "map", "languages.dotnet.enabled": "switch",
    "languages.dotnet.projects": "list", "languages.dotnet.projects[]": "string", "analyzers": "map", "analyzers.syntax": "map", "analyzers.syntax.enabled": "switch",
    "analyzers.cargo_modules": "map", "analyzers.cargo_modules.enabled": "switch", "analyzers.roslyn": "map", "analyzers.roslyn.enabled": "switch", "analyzers.roslyn.timeout": "string",
    "coverage": "map", "coverage.enabled": "bool", "coverage.sources": "list", "coverage.sources[]": "map", "coverage.sources[].path": "string", "coverage.sources[].format": "string",
    "coverage.sources[].sidecar_path": "string", "coverage.sources[].max_bytes": "int", "coverage.sources[].max_facts": "int",
}
_MODE = ["deny", "ask", "off"]
#: Allowed words by pattern (fixed values).
WORDS = {
    "gate": ["advisory", "required"], "modules.*.volatility": ["low", "medium", "high"], "modules.*.subdomain": ["core", "supporting", "generic"],
    "coverage.sources[].format": ["auto", "go-coverprofile", "lcov", "coverage-py-json", "llvm-cov-json", "cobertura"],
    **{f"builtin.{r}": _MODE for r in ("graph", "coupling", "duplication", "cycle", "layers", "unowned")},
    **{p: ["true", "false", "auto"] for p, kind in SCHEMA.items() if kind == "switch"},
}
#: Values of keys that a file leaves out (fixed values).
DEFAULTS = {"gate": "advisory", "builtin.graph": "ask", "builtin.coupling": "deny", "builtin.duplication": "ask", "builtin.cycle": "deny", "builtin.layers": "deny", "builtin.unowned": "deny", "builtin.min_balance": "7"}
SETTINGS = ["languages", "analyzers", "coverage"]
DURATION = r"^([0-9]+(\.[0-9]+)?(ns|us|µs|ms|s|m|h))+$"


def path(keys: Column) -> Column:
    """The keys as a path: a.b[0]."""
    return F.regexp_replace(F.array_join(keys, "."), r"\.(\[\d+\])", "$1")


def patterned(values: DataFrame) -> DataFrame:
    """values with path, pattern and the pattern of their parent."""
    keys = F.col("keys")
    named = F.transform(keys, lambda k, i: F.when(k.rlike(r"^\[\d+\]$"), "[]").when((i == 1) & (F.get(keys, F.lit(0)) == "modules"), "*").otherwise(k))
    pattern = F.regexp_replace(F.array_join(named, "."), r"\.\[\]", "[]")
    size = F.size(keys)
    above = F.when(size > 0, F.regexp_replace(F.array_join(F.slice(named, 1, F.greatest(size - 1, F.lit(0))), "."), r"\.\[\]", "[]"))
    return values.select(F.col("doc").alias("policy"), "at", "keys", "kind", "value", path(keys).alias("path"), pattern.alias("pattern"), above.alias("above"))


def _fits() -> Column:
    want = F.col("want")
    return (
        (F.col("kind") == want) | (F.col("kind") == "null")
        | ((want == "names") & F.col("kind").isin("string", "list")) | ((want == "switch") & F.col("kind").isin("string", "bool", "int", "float"))
    )


def _shape(v: DataFrame) -> DataFrame:
    """Unreadable files, unknown and double keys, values of the wrong kind, words that are not allowed."""
    spark = v.sparkSession
    schema = F.broadcast(spark.createDataFrame(list(SCHEMA.items()), "pattern string, want string"))  # fixed, some hundred rows
    words = F.broadcast(spark.createDataFrame(list(WORDS.items()), "pattern string, words array<string>"))
    known = v.join(schema, "pattern", "left").join(schema.select(F.col("pattern").alias("above"), F.col("want").alias("above_want")), "above", "left").join(words, "pattern", "left")
    problem = (
        F.when(F.col("kind") == "unreadable", F.concat(F.lit("cannot be read: "), "value")).when(F.col("kind") == "duplicate", "given twice")
        .when(F.col("want").isNull() & (F.col("above_want").isNotNull() & F.col("above_want").isin("map", "list", "names")), "unknown key")
        .when(F.col("want").isNotNull() & ~_fits(), F.concat(F.lit("must be "), F.replace(F.replace("want", F.lit("names"), F.lit("a name or list")), F.lit("switch"), F.lit("true, false or auto"))))
        .when((F.col("kind") == "null") & F.col("want").isin("string", "int", "bool", "names", "switch") | (F.col("pattern") == "exceptions[].to") & (F.col("value") == ""), "empty")
        .when(F.col("words").isNotNull() & F.col("value").isNotNull() & ~F.array_contains("words", F.col("value")), F.concat(F.lit("is not one of "), F.array_join("words", ", ")))
        .when((F.col("pattern") == "builtin.min_balance") & ~F.coalesce(F.col("value").try_cast("int").between(1, 10), F.lit(False)) & (F.col("kind") == "int"), "is outside 1 to 10")
        .when(F.col("pattern").isin("coverage.sources[].max_bytes", "coverage.sources[].max_facts") & (F.col("value").try_cast("long") < 1), "is below 1")
        .when((F.col("pattern") == "analyzers.roslyn.timeout") & ~F.col("value").rlike(DURATION), "is not a duration")
        .when((F.col("pattern") == "exceptions[].expires") & (~F.coalesce("value", F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("value").try_cast("date").isNull()), "is not a date")
    )
    wrong = known.withColumn("problem", problem).where("problem IS NOT NULL").select("policy", "path", "problem")
    twice = v.where("pattern = 'layers[]'").groupBy("policy", "value").agg(F.count("*").alias("n")).where("n > 1").select("policy", F.lit("layers").alias("path"), F.concat("value", F.lit(" is listed twice")).alias("problem"))
    return wrong.unionByName(twice)


def _has(name: str) -> Column:
    """Whether a container has a key with a value."""
    return F.coalesce(F.bool_or((F.col("key") == name) & (F.col("kind") != "null") & (F.coalesce("value", F.lit("x")) != "")), F.lit(False)).alias(name)


def _text(name: str) -> Column:
    return F.max(F.when(F.col("key") == name, F.col("value")))


def _top(v: DataFrame) -> DataFrame:
    """Required keys of the file and of its modules and coverage."""
    files = v.groupBy("policy").agg(F.bool_or(F.col("kind") == "unreadable").alias("bad"), *(F.max(F.when(F.col("pattern") == p, F.coalesce("value", F.lit("")))).alias(p) for p in ("version", "owners", "modules")), F.max(F.when(F.col("pattern") == "version", F.col("kind"))).alias("kind"), F.max(F.when(F.col("pattern") == "coverage.enabled", F.col("value"))).alias("on"), F.max(F.when(F.col("pattern") == "coverage.sources", F.col("value"))).alias("sources"))

    def item(test: Column, path: str, problem: str) -> Column:
        return F.when(test, F.struct(F.lit(path).alias("path"), F.lit(problem).alias("problem")))

    version, empty = F.col("version"), lambda c: F.coalesce(F.col(c), F.lit("0")).isin("0", "")
    found = F.array_compact(F.array(
        item(version.isNull() | (version == ""), "version", "missing"), item((version == "2") & (F.col("kind") == "int"), "version", "the older format"),
        item((version != "") & ((F.col("kind") != "int") | ~version.isin("2", VERSION)), "version", "not read by this engine"),
        item(empty("owners"), "owners", "required"), item(empty("modules"), "modules", "required"),
        item((F.col("on") == "true") & empty("sources"), "coverage.sources", "required when coverage is enabled"),
    ))
    top = files.where("NOT bad").select("policy", F.explode(found).alias("x")).select("policy", "x.path", "x.problem")
    modules = v.where("pattern = 'modules.*'").select("policy", F.col("path").alias("base"))
    inner = v.where("pattern IN ('modules.*.paths', 'modules.*.public')").select("policy", F.regexp_replace("path", r"\.[a-z]+$", "").alias("base"), F.try_element_at("keys", F.lit(-1)).alias("key"), "kind", "value")
    by = modules.join(inner, ["policy", "base"], "left").groupBy("policy", "base").agg(_text("paths").alias("paths"), F.max(F.when((F.col("key") == "public") & (F.col("kind") == "list"), F.col("value"))).alias("public"))
    lists = by.select("policy", F.explode(F.array_compact(F.array(F.when(F.coalesce("paths", F.lit("0")) == "0", F.struct(F.concat("base", F.lit(".paths")).alias("path"), F.lit("required").alias("problem"))), F.when(F.col("public") == "0", F.struct(F.concat("base", F.lit(".public")).alias("path"), F.lit("empty").alias("problem")))))).alias("x")).select("policy", "x.path", "x.problem")
    sources = _fields(v, "coverage.sources[]").agg(_has("path")).where("NOT path").select("policy", F.concat("base", F.lit(".path")).alias("path"), F.lit("required").alias("problem"))
    return top.unionByName(lists).unionByName(sources)


def _fields(v: DataFrame, container: str):
    """The fields below each container of a pattern, grouped by it; deeper keys joined by a dot."""
    depth = 2 if container != "coverage.sources[]" else 3
    root = container.removesuffix("[]")
    own = v.where((F.col("pattern") == container) | F.col("pattern").startswith(container + "."))
    key = F.array_join(F.expr(f"slice(keys, {depth + 1}, 9)"), ".")
    base = F.concat(F.lit(root), F.get("keys", F.lit(depth - 1)))
    return own.select("policy", base.alias("base"), key.alias("key"), "kind", "value", "at").groupBy("policy", "base")


def _pick(by: DataFrame, tests: list[tuple[Column, str, str]]) -> DataFrame:
    found = [F.when(test, F.struct(F.concat("base", F.lit(f".{field}" if field else "")).alias("path"), F.lit(problem).alias("problem"))) for test, field, problem in tests]
    return by.select("policy", F.explode(F.array_compact(F.array(*found))).alias("x")).select("policy", "x.path", "x.problem")


def _rules(v: DataFrame) -> DataFrame:
    names = ("deny.from", "deny.to", "only.in")
    flags = [_has(n).alias(n.replace(".", "_")) for n in ("id", "deny", "only", "note", "why", "instead", "only.use", *names)]
    empty = [F.coalesce(F.bool_or((F.col("key") == n) & (F.col("kind") == "list") & (F.col("value") == "0")), F.lit(False)).alias(n.replace(".", "_") + "_empty") for n in names]
    by = _fields(v, "rules[]").agg(*flags, *empty)
    forms = F.col("deny").cast("int") + F.col("only").cast("int") + F.col("note").cast("int")
    tests = [
        (~F.col("id"), "id", "required"), (forms == 0, "", "needs one of deny, only or note"), (forms > 1, "", "has more than one of deny, only and note"), (~F.col("why"), "why", "required"),
        (F.col("deny") & ~F.col("instead"), "instead", "required with deny"), (F.col("only") & ~F.col("only_use"), "only.use", "required"),
    ]
    for n in names:
        c = n.replace(".", "_")
        tests += [(F.col(n.split(".")[0]) & ~F.col(c) & ~F.col(c + "_empty"), n, "required"), (F.col(c + "_empty"), n, "empty")]
    return _pick(by, tests)


def _exceptions(v: DataFrame) -> DataFrame:
    only = _fields(v, "rules[]").agg(_text("id").alias("id"), _has("only")).where("only").select("policy", F.col("id").alias("rule_id")).distinct().withColumn("library", F.lit(True))
    by = _fields(v, "exceptions[]").agg(_text("rule").alias("rule_id"), *(_has(n) for n in ("rule", "from", "to", "why")))
    by = by.join(only, ["policy", "rule_id"], "left").withColumn("library", F.coalesce("library", F.lit(False)))
    free = F.coalesce(F.col("rule_id") == "unowned", F.lit(False))
    return _pick(by, [
        (~F.col("rule"), "rule", "required"), (~F.col("from"), "from", "required"), (~F.col("why"), "why", "required"), (free & F.col("to"), "to", "unowned has no target"),
        (~free & F.col("library") & F.col("to"), "to", "an only rule names its library"), (~free & ~F.col("library") & ~F.col("to"), "to", "required"),
    ])


def problems(values: DataFrame) -> DataFrame:
    """(policy, path, problem) of everything that keeps a file from being a policy; values: as document.values, written."""
    v = cut(patterned(values), "policy-patterns")
    return cut(reduce(DataFrame.unionByName, [_shape(v), _top(v), _rules(v), _exceptions(v)]).distinct(), "policy-problems")


def rows(values: DataFrame, wrong: DataFrame) -> DataFrame:
    """(policy, section, name, field, pos, value) of files without a problem, with defaults."""
    v = cut(patterned(values).join(wrong.select("policy").distinct(), "policy", "left_anti"), "policies")
    keys, last = F.col("keys"), F.try_element_at("keys", F.lit(-1))
    place = F.coalesce(F.regexp_extract(last, r"^\[(\d+)\]$", 1).try_cast("int"), F.lit(0))
    leaf = v.where(~F.col("kind").isin("map", "list", "null"))
    out = ["policy", "section", "name", "field", "pos", "value"]

    def made(section: str, name: Column | str, field: Column, rows: DataFrame, pos: Column = place, value: Column | str = "value") -> DataFrame:
        return rows.select("policy", F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), field.alias("field"), pos.alias("pos"), (F.col(value) if isinstance(value, str) else value).alias("value"))

    modules = made("module", F.get(keys, F.lit(1)), F.get(keys, F.lit(2)), leaf.where("get(keys, 0) = 'modules'"))
    by = modules.groupBy("policy", "name").agg(F.bool_or(F.col("field") == "public").alias("public"), F.bool_or(F.col("field") == "volatility").alias("vol"), F.max(F.when(F.col("field") == "subdomain", F.col("value"))).alias("sub"))
    public = modules.where("field = 'paths'").join(by.where("NOT public").select("policy", "name"), ["policy", "name"]).withColumn("field", F.lit("public")).select(*out)
    vol = by.where("NOT vol").select("policy", F.lit("module").alias("section"), "name", F.lit("volatility").alias("field"), F.lit(0).alias("pos"), F.when(F.col("sub").isin("supporting", "generic"), "low").otherwise("high").alias("value"))

    ids = _fields(v, "rules[]").agg(_text("id").alias("id"), _has("deny"), _has("only"))
    in_rules = leaf.where("get(keys, 0) = 'rules'").withColumn("base", F.concat(F.lit("rules"), F.get(keys, F.lit(1)))).join(ids.select("policy", "base", "id"), ["policy", "base"])
    field = F.array_join(F.filter(F.expr("slice(keys, 3, 9)"), lambda k: ~k.rlike(r"^\[\d+\]$")), ".")
    rules = made("rule", F.col("id"), field, in_rules.where(field != "id"))
    form = ids.select("policy", F.lit("rule").alias("section"), F.col("id").alias("name"), F.lit("form").alias("field"), F.lit(0).alias("pos"), F.when(F.col("deny"), "deny").when(F.col("only"), "only").otherwise("note").alias("value"))

    ends = _fields(v, "exceptions[]").agg(*(_text(n).alias(n) for n in ("rule", "from", "to")), F.min("at").alias("at"))
    label = F.concat_ws(" ", "rule", F.concat_ws(" > ", "from", "to"))
    nth = F.row_number().over(Window.partitionBy("policy", "label").orderBy("at"))
    named = ends.withColumn("label", label).withColumn("nth", nth).select("policy", "base", F.when(F.col("nth") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" #"), F.col("nth").cast("string"))).alias("label"))
    exceptions = made("exception", F.col("label"), F.get(keys, F.lit(2)), leaf.where("get(keys, 0) = 'exceptions'").withColumn("base", F.concat(F.lit("exceptions"), F.get(keys, F.lit(1)))).join(named, ["policy", "base"]))

    builtin = made("builtin", F.when(F.get(keys, F.lit(1)) == "min_balance", "coupling").otherwise(F.get(keys, F.lit(1))), F.when(F.get(keys, F.lit(1)) == "min_balance", "min_balance").otherwise(F.lit("mode")), leaf.where("get(keys, 0) = 'builtin'"))
    top = made("top", "", F.get(keys, F.lit(0)), leaf.where(F.get(keys, F.lit(0)).isin("owners", "gate", "layers", "generated", "tests", "exclude")))
    settings = made("setting", "", F.col("path"), leaf.where(F.get(keys, F.lit(0)).isin(*SETTINGS)))
    given = cut(reduce(DataFrame.unionByName, [modules, public, vol, rules, form, exceptions, builtin, top, settings]).select(*out), "policy-rows")
    defaults = [("top", "", "gate", DEFAULTS["gate"])] + [("builtin", "coupling" if k == "builtin.min_balance" else k[8:], "min_balance" if k == "builtin.min_balance" else "mode", d) for k, d in DEFAULTS.items() if k != "gate"]
    table = F.broadcast(v.sparkSession.createDataFrame(defaults, "section string, name string, field string, value string"))  # eight rows
    filled = v.select("policy").distinct().crossJoin(table).join(given.select("policy", "section", "name", "field").distinct(), ["policy", "section", "name", "field"], "left_anti")
    return cut(given.unionByName(filled.withColumn("pos", F.lit(0)).select(*out)), "policy-rows")
