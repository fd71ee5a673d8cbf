"""Policies as rows: checks and the direction of a change.

A policy is rows (policy, section, name, field, pos, value) with its defaults filled in: section `module`, `rule`, `exception`
(name: its key, numbered where repeated), `builtin`, `setting` or `top` (name empty).  Lists have a row a value; every module
has a `paths` row, every rule a `form` row, every exception a `rule` row.  Many policies go through one plan: all joins
are on (policy, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import parts

LOOSENS, TIGHTENS, NEITHER = "loosens", "tightens", "neither"
#: What an added and a removed value of a list mean, and how its values are compared.
LISTS = [
    ("module", "paths", LOOSENS, LOOSENS, "name"), ("module", "public", LOOSENS, TIGHTENS, "glob"), ("module", "depends_on", LOOSENS, TIGHTENS, "name"),
    ("rule", "deny.from", TIGHTENS, LOOSENS, "selector"), ("rule", "deny.to", TIGHTENS, LOOSENS, "selector"), ("rule", "only.in", LOOSENS, TIGHTENS, "selector"),
    ("top", "generated", LOOSENS, TIGHTENS, "glob"), ("top", "tests", LOOSENS, TIGHTENS, "glob"), ("top", "exclude", LOOSENS, TIGHTENS, "glob"),
]
RANKS = {"volatility": ["low", "medium", "high"], "mode": ["off", "ask", "deny"]}
BUILTIN = ["graph", "coupling", "duplication", "cycle", "layers", "unowned"]
MOST_EDITS = 2

_KEY = ["policy", "section", "name", "field"]
_NAMED = ["module", "rule", "exception"]


def _meta(c: Column) -> Column:
    return c.rlike(r"[*?\[{]")


def covers(wide: Column, narrow: Column) -> Column:
    """Whether every path of one glob is plainly one of the other's: equal, all, or below its directory."""
    base = F.regexp_extract(wide, r"^(.*)/\*\*$", 1)
    below = wide.endswith("/**") & ~_meta(base) & ((narrow == base) | F.startswith(narrow, F.concat(base, F.lit("/"))))
    return (wide == narrow) | (wide == "**") | below


def may_overlap(a: Column, b: Column) -> Column:
    """Whether two globs may name one path: one literal start begins with the other's."""
    x, y = (F.regexp_extract(c, r"^([^*?\[{]*)", 1) for c in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def _is_list(kinds: tuple[str, ...] = ("name", "glob", "selector")) -> Column:
    return reduce(Column.__or__, ((F.col("section") == r[0]) & (F.col("field") == r[1]) for r in LISTS if r[4] in kinds))


def _marked(p: DataFrame) -> DataFrame:
    """p with glob: whether a value of a list is compared as one.  A selector that looks like a path is one, unless a module has that name."""
    looks = _meta(F.col("value")) | F.col("value").contains("/")
    rows = p.select(*_KEY, "pos", "value").withColumn("odd", F.coalesce(_is_list(("selector",)) & looks, F.lit(False)))
    names = p.where("section = 'module'").select("policy", F.col("name").alias("value")).distinct().where(looks).withColumn("is_module", F.lit(True))
    odd = rows.where("odd").join(names, ["policy", "value"], "left").withColumn("glob", F.col("is_module").isNull())
    return rows.where("NOT odd").withColumn("glob", _is_list(("glob",))).unionByName(odd.drop("is_module")).drop("odd")


def _up(order: list[str], a: Column, b: Column) -> Column:
    place = F.array(*map(F.lit, order))
    return F.when(F.array_position(place, b) > F.array_position(place, a), TIGHTENS).otherwise(LOOSENS)


def _scalar(before: Column, after: Column) -> Column:
    """Direction of a field with one value that has changed; null: no such field."""
    s, f = F.col("section"), F.col("field")
    more = F.when(after.try_cast("double") > before.try_cast("double"), TIGHTENS).otherwise(LOOSENS)
    date = F.when(after.isNull(), LOOSENS).when(before.isNull(), TIGHTENS).when(after > before, LOOSENS).otherwise(TIGHTENS)
    return (
        F.when(f.isin("why", "note", "instead", "subdomain"), NEITHER)
        .when((s == "module") & (f == "volatility"), _up(RANKS["volatility"], before, after))
        .when((s == "module") & (f == "layer"), F.when(before.isNull(), TIGHTENS).otherwise(LOOSENS))
        .when((s == "builtin") & (f == "min_balance"), more)
        .when(s == "builtin", _up(RANKS["mode"], before, after))
        .when((s == "rule") & (f == "form"), F.when(before == "note", TIGHTENS).otherwise(LOOSENS))
        .when((s == "rule") & (f == "only.use"), LOOSENS)
        .when((s == "exception") & (f == "expires"), date)
        .when((s == "top") & (f == "gate"), F.when(after == "required", TIGHTENS).otherwise(LOOSENS))
        .when((s == "top") & f.isin("owners", "layers"), LOOSENS)
        .when(s == "setting", F.when(f.rlike(r"^coverage(?:\.|$)"), NEITHER).otherwise(LOOSENS))
    )


def _single(values: Column) -> Column:
    """The one value of a field; owners in any order and layers in theirs make one value, no values null."""
    ordered = F.array_sort(F.transform(values, lambda x: F.struct(F.when(F.col("field") == "layers", x["pos"]).alias("p"), x["value"].alias("value"))))
    return F.when(F.size(values) > 0, F.array_join(F.transform(ordered, lambda x: x["value"]), ", "))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(policy, section, name, field, direction, before, after): what a change of policies loosens or tightens.

    A module, rule or exception that one side lacks is one row with a null field; so is nothing of its fields.

    Rows are dealt by policy once; a field is one row with its values on both sides, and what a name needs of its other fields
    is a window.  The partitions are counted: rows of policies compress so well that by size very many would share a task."""
    sides = [_marked(p).withColumn("side", F.lit(k)) for k, p in enumerate((before, after))]
    rows = sides[0].unionByName(sides[1]).repartition(parts(before.sparkSession), "policy")
    held = [F.collect_list(F.when(F.col("side") == k, F.struct("pos", "value", "glob"))).alias(c) for k, c in enumerate("ba")]
    fields = rows.groupBy(*_KEY).agg(*held)

    w = Window.partitionBy(*_KEY[:3])
    named, scalar = F.col("section").isin(_NAMED), ~_is_list()
    fields = fields.withColumns({"before": F.when(scalar, _single(F.col("b"))), "after": F.when(scalar, _single(F.col("a")))})
    turned = (F.col("section") == "rule") & (F.col("field") == "form") & ~F.col("before").eqNullSafe(F.col("after"))

    def sorted_of(side: str, field: str) -> Column:
        values = F.array_sort(F.filter(F.transform(side, lambda x: x["value"]), lambda v: v.isNotNull()))
        return F.coalesce(F.max(F.when((F.col("section") == "module") & (F.col("field") == field), values)).over(w), F.array().cast("array<string>"))

    fields = fields.withColumns({
        "in_b": F.max(F.size("b") > 0).over(w), "in_a": F.max(F.size("a") > 0).over(w), "turned": F.max(turned).over(w), "least": F.min("field").over(w),
        **{f"{f}_{s}": sorted_of(s, f) for s in "ba" for f in ("paths", "public")},
    })
    lacks = named & ~(F.col("in_b") & F.col("in_a"))
    # modules whose public part is the whole module on both sides
    whole = (F.col("section") == "module") & (F.col("field") == "public") & (F.col("paths_b") == F.col("public_b")) & (F.col("paths_a") == F.col("public_a"))
    null = F.lit(None).cast("string")

    def row(field: Column, way: Column, x: Column, y: Column) -> Column:
        return F.struct(field.alias("field"), way.alias("direction"), x.alias("before"), y.alias("after"))

    added = F.when(F.col("section") == "rule", TIGHTENS).otherwise(LOOSENS)
    removed = F.when(F.col("section") == "exception", TIGHTENS).otherwise(LOOSENS)
    here = row(null, F.when(F.col("in_b"), removed).otherwise(added), F.when(F.col("in_b"), F.col("name")), F.when(F.col("in_a"), F.col("name")))
    way = _scalar(F.col("before"), F.col("after"))
    one = row(F.col("field"), way, F.col("before"), F.col("after"))

    def lost(x: str, y: str, at: int) -> Column:
        def alike(v, o):
            return (v["glob"] == o["glob"]) & F.when(v["glob"], covers(o["value"], v["value"])).otherwise(o["value"] == v["value"])

        gone = F.filter(x, lambda v: ~F.coalesce(F.exists(y, lambda o: alike(v, o)), F.lit(False)))
        way = reduce(lambda c, r: c.when((F.col("section") == r[0]) & (F.col("field") == r[1]), r[at]), LISTS, F.when(F.lit(False), ""))
        return F.transform(gone, lambda v: row(F.col("field"), way, *((null, v["value"]) if at == 2 else (v["value"], null))))

    found = (
        F.when(lacks, F.when(F.col("field") == F.col("least"), F.array(here)))
        .when(scalar, F.when(~F.col("before").eqNullSafe(F.col("after")) & way.isNotNull(), F.array(one)))
        .when(~F.col("turned") & ~whole, F.concat(lost("a", "b", 2), lost("b", "a", 3)))
    )
    return fields.select(*_KEY[:3], F.explode(found).alias("x")).select(*_KEY[:3], "x.field", "x.direction", "x.before", "x.after")


def direction(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """(policy, direction): a change that loosens anything loosens."""
    by = changes.groupBy("policy").agg(F.bool_or(F.col("direction") == LOOSENS).alias("l"), F.bool_or(F.col("direction") == TIGHTENS).alias("t"))
    way = F.when(F.col("l"), LOOSENS).when(F.col("t"), TIGHTENS).otherwise(NEITHER)
    return policies.select("policy").distinct().join(by, "policy", "left").select("policy", way.alias("direction"))


def check(p: DataFrame) -> DataFrame:
    """(policy, section, name, field, value, problem, suggestion): names that name nothing, ids taken twice.

    suggestion is the nearest name of its kind within two edits, the first by order among equals."""
    modules = p.where("section = 'module'").select("policy", F.col("name").alias("known")).distinct()
    rules = p.where("section = 'rule' AND field = 'form'").select("policy", F.col("name").alias("known"), F.col("value").alias("form"))
    builtin = p.select("policy").distinct().select("policy", F.explode(F.array(*map(F.lit, BUILTIN))).alias("known"))
    layers = p.where("section = 'top' AND field = 'layers'").select("policy", F.col("value").alias("known"))
    ids = rules.select("policy", "known").unionByName(builtin).distinct()
    path = _meta(F.col("value")) | F.col("value").contains("/")
    free = p.where("section = 'exception' AND field = 'rule' AND value = 'unowned'").select("policy", "section", "name", F.lit("from").alias("field"))
    own = p.where("section = 'exception' AND field = 'rule'").join(rules.where("form = 'only'").select("policy", F.col("known").alias("value")), ["policy", "value"]).select("policy", "section", "name", F.lit("to").alias("field"))
    ends = p.where("section = 'exception' AND field IN ('from', 'to') AND value <> ''").join(free, _KEY, "left_anti")
    asked = p.where("section = 'module' AND field = 'depends_on'").unionByName(p.where("section = 'rule' AND field IN ('deny.from', 'deny.to', 'only.in')").where(~path)).unionByName(ends.join(own, _KEY, "left_anti"))

    def unknown(rows: DataFrame, known: DataFrame, problem: str, near: bool) -> DataFrame:
        on = (F.col("r.policy") == F.col("k.policy")) & (F.col("r.value") == F.col("k.known"))
        rows = rows.select(*_KEY, "value").distinct()
        bad = rows.alias("r").join(known.alias("k"), on, "left_anti").withColumn("problem", F.lit(problem))
        if not near:
            return bad.withColumn("suggestion", F.lit(None).cast("string"))
        edits = F.levenshtein("value", "known")
        found = bad.select("policy", "value").distinct().join(known, "policy").where(F.levenshtein("value", "known", MOST_EDITS) >= 0)
        found = found.groupBy("policy", "value").agg(F.min(F.struct(edits.alias("d"), "known"))["known"].alias("suggestion"))
        return bad.join(found, ["policy", "value"], "left")

    none = F.lit(None).cast("string")
    taken = rules.join(builtin, ["policy", "known"], "left_semi").withColumn("problem", F.lit("built-in id"))
    twice = rules.join(builtin, ["policy", "known"], "left_anti").groupBy("policy", "known").agg(F.count("*").alias("n")).where("n > 1").withColumn("problem", F.lit("id of two rules"))
    named = taken.select("policy", "known", "problem").distinct().unionByName(twice.select("policy", "known", "problem"))
    named = named.select("policy", F.lit("rule").alias("section"), F.col("known").alias("name"), F.lit("id").alias("field"), F.col("known").alias("value"), "problem", none.alias("suggestion"))
    parts = [
        unknown(asked, modules, "not a module", True), unknown(p.where("section = 'module' AND field = 'layer'"), layers, "not a layer", False),
        unknown(p.where("section = 'exception' AND field = 'rule'"), ids, "not a rule", True),
        p.where("value <> ''").join(own, _KEY, "left_semi").select(*_KEY, "value", F.lit("an only rule names its library").alias("problem"), none.alias("suggestion")),
    ]
    return reduce(DataFrame.unionByName, parts, named)
