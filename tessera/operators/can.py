"""Whether a policy lets a dependency come about that need not exist yet: yes, no with the rule, or unknown with the next step.

A side of a question is, in this order: a module by name (as a target: its public part); a file or a directory of the
tree; an import path inside a module of go.mod; else a file not written yet or, as a target, a library, unless its first
segment is an entry of the root.  Each argument is resolved once for all questions that name it.  Ends are a written table.
A directory as importer is judged as its files are: they are reduced to distinct profiles (module, language, rules that name them), of which a
directory has few, and questions meet profiles.  What is aggregated to arrays is rules of the policy, never files.

A module by name has no path, so a rule that names paths may or may not mean it.  Questions are judged twice, the
second time with every glob that may overlap a path of the module taken to cover it: an error of one judgement alone
leaves the answer open, and so does an ``only`` rule that turns on the importer's language where there is none.

Defined results: a question without one of its sides has a null answer; questions that repeat are answered each; an
importer that is a declared test or generated file is out of every rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import balance, directory, worse_volatility
from ..functions.globs import glob_regex
from ..sources.code import language
from ..sources.scratch import cut
from .judge import MIN_BALANCE, MODES
from .policy import may_overlap
from .uses import ancestors, longest_prefix, module_of

#: Separators below a library's name, by language; other languages take a slash (fixed values).
SEPARATORS = {"python": ".", "dotnet": ".", "rust": "::", "go": "/", "typescript": "/"}
RULES = """pos int, id string, form string, side_from array<struct<name:string,module:boolean,regex:string>>, side_to array<struct<name:string,module:boolean,regex:string>>,
 library string, entries array<struct<lang:string,root:string,exact:boolean>>, why string, instead string"""
ANSWER = ["id", "from", "to", "answer", "rule", "what", "why", "instead", "balance", "next"]
_ERROR = "struct<rule:string,own:boolean,to:string,what:string,why:string,instead:string,fix:boolean,sure:boolean,narrow:boolean,lang:boolean>"


def rules_table(spark: SparkSession, rules: list[dict], modules: list[str], sets: dict[str, list[tuple]] | None = None) -> DataFrame:
    """Rules of a policy in its order: dicts with id, form (deny: from, to; only: use, in), why and instead.

    sets: entries (language, root, exact) of package sets by name; what is in no set is a library.
    """
    def side(names):
        return [(n, n in modules, None if n in modules else glob_regex(n)) for n in names or []]

    rows = []
    for pos, r in enumerate(rules):
        use = r.get("use")
        entries = (sets or {}).get(use, [(None, use, False)] if use else [])
        rows.append((pos, r["id"], r["form"], side(r.get("from") or r.get("in")), side(r.get("to")), use, entries, r.get("why"), r.get("instead")))
    return spark.createDataFrame(rows, RULES)


def clean(path: Column) -> Column:
    """The path without empty and dot segments, '..' resolved where something is before it; '' for the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    def step(acc, p):
        up = (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def tree_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(file, excluded, dir, module) of the files of a tree; files: file, class."""
    own = files.groupBy("file").agg(F.bool_and(F.col("class").isin("test", "generated")).alias("excluded"))
    return own.join(module_of(own, paths), "file").withColumn("dir", F.when(F.col("file").contains("/"), directory(F.col("file"))).otherwise(""))


def sides(args: DataFrame, tree: DataFrame, modules: DataFrame, paths: DataFrame, go_modules: DataFrame | None = None) -> DataFrame:
    """(arg, target, kind, path, module, lang) of arguments (arg, target); kind: module, file, dir, library or none."""
    known = modules.select(F.col("module").alias("arg"), F.lit(True).alias("named")).distinct()
    rows = args.distinct().join(known, "arg", "left").withColumn("rel", clean(F.col("arg")))
    files = tree.select(F.col("file").alias("rel"), F.lit(True).alias("is_file"))
    held = tree.select(F.explode(ancestors(F.col("dir"))).alias("rel")).distinct()
    rows = rows.join(files, "rel", "left").join(held.withColumn("is_dir", F.lit(True)), "rel", "left")
    first = F.regexp_extract("rel", "^([^/]*)", 1)
    first = F.when(F.col("rel").contains("/"), first).when(F.col("rel").contains("."), F.regexp_extract("rel", "^([^.]*)", 1))
    root = tree.select(F.regexp_extract("file", "^([^/]*)", 1).alias("first")).distinct().withColumn("at_root", F.lit(True))
    rows = rows.withColumn("first", first).join(root, "first", "left")
    rows = rows.withColumns({"go_dir": F.lit(None).cast("string")})
    if go_modules is not None:
        asked = rows.select(F.col("arg").alias("path")).distinct()
        inside = longest_prefix(asked, go_modules.select(F.col("path").alias("prefix"))).where("prefix IS NOT NULL")
        rest = F.expr("trim(LEADING '/' FROM substring(p.path, length(prefix) + 1))")
        found = inside.alias("p").join(go_modules.alias("g"), F.col("prefix") == F.col("g.path")).select(F.col("p.path").alias("arg"), clean(F.concat(F.col("g.dir"), F.lit("/"), rest)).alias("found"))
        rows = rows.join(found, "arg", "left").withColumn("go_dir", F.col("found"))
    inner = F.col("arg").startswith("./") | F.col("arg").startswith("/") | (F.col("rel") == "..") | F.col("rel").startswith("../") | F.col("at_root").isNotNull()
    kind = (
        F.when(F.col("named"), "module").when(F.col("is_file"), "file").when(F.col("is_dir"), "dir").when(F.col("go_dir").isNotNull(), "dir")
        .when(F.col("target") & ~inner, "library").when(F.col("rel").rlike(r"[^/]*\.[^./]*$"), "file").otherwise("none")
    )
    by_go = (kind == "dir") & F.col("is_dir").isNull()
    path = F.when(kind == "module", None).when(by_go, F.col("go_dir")).when((kind == "library"), F.col("arg")).otherwise(F.col("rel"))
    rows = rows.select("arg", "target", kind.alias("kind"), path.alias("path"), F.when(by_go, "go").alias("go"))
    own = module_of(rows.where("kind NOT IN ('module', 'library')").select(F.col("path").alias("file")), paths).withColumnRenamed("file", "path")
    by = tree.groupBy("dir").agg(F.count_if(~F.col("excluded")).alias("n"), F.collect_set(F.when(~F.col("excluded"), F.col("module"))).alias("p"), F.collect_set("module").alias("q"))
    agreed = by.withColumn("m", F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("q"))).where("size(m) = 1").select(F.col("dir").alias("path"), F.col("m")[0].alias("agreed"))
    rows = rows.join(own, "path", "left").join(agreed, "path", "left")
    module = F.when(F.col("kind") == "module", F.col("arg")).when(F.col("kind") == "library", None).when(F.col("kind") == "dir", F.coalesce("agreed", "module")).otherwise(F.col("module"))
    spoken = F.when(F.col("kind") == "file", F.nullif(language(F.col("path")), F.lit(""))).otherwise(F.col("go"))
    return rows.select("arg", "target", "kind", "path", module.alias("module"), spoken.alias("lang"))


def _first(names: Column, module: Column, path: Column) -> Column:
    """Place (from 1) of the first name that the end matches; null where none does."""
    hit = F.transform(names, lambda n: F.coalesce(F.when(n["module"], n["name"] == module).otherwise(F.rlike(path, n["regex"])), F.lit(False)))
    return F.nullif(F.array_position(hit, F.lit(True)).cast("int"), F.lit(0))


def _matched(rows: DataFrame, rules: DataFrame, side: str) -> DataFrame:
    """rows (module, path) with hits: (pos, place) of each rule that names the end."""
    every = rules.select(F.struct("pos", F.col(side).alias("names")).alias("r")).agg(F.collect_list("r").alias("_rules"))
    hits = F.transform("_rules", lambda r: F.struct(r["pos"].alias("pos"), _first(r["names"], F.col("module"), F.col("path")).alias("place")))
    return rows.crossJoin(F.broadcast(every)).withColumn("hits", F.array_sort(F.filter(hits, lambda h: h["place"].isNotNull()))).drop("_rules")


def _widened(rules: DataFrame, paths: DataFrame, side: str) -> DataFrame:
    """(module, wide): places of the rules with a glob that may overlap a path of the module."""
    globs = paths.groupBy("module").agg(F.collect_set("glob").alias("globs"))
    every = rules.select(F.struct("pos", F.filter(side, lambda n: ~n["module"])["name"].alias("names")).alias("r")).agg(F.collect_list("r").alias("_rules"))
    near = F.filter("_rules", lambda r: F.exists(r["names"], lambda n: F.exists(F.col("globs"), lambda g: may_overlap(n, g))))
    return globs.crossJoin(F.broadcast(every)).select("module", F.transform(near, lambda r: r["pos"]).alias("wide"))


def importers(ends: DataFrame, tree: DataFrame, rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct profiles of each importer: (arg, kind, path, is_file, module, lang, skip, hits, wide)."""
    dirs = ends.where("NOT target AND kind = 'dir'")
    counts = tree.groupBy("dir").agg(F.count_if(~F.col("excluded")).alias("n")).select(F.col("dir").alias("path"), "n")
    # a directory of tests and generated files alone answers as they do
    inner = dirs.select("arg", "path").join(counts, "path").alias("d").join(tree.alias("t"), F.col("d.path") == F.col("t.dir")).where("NOT excluded OR n = 0")
    inner = inner.select("arg", F.lit("dir").alias("kind"), F.col("file").alias("path"), F.lit(True).alias("is_file"), "t.module", F.nullif(language(F.col("file")), F.lit("")).alias("lang"), F.col("excluded").alias("skip"))
    excluded = tree.where("excluded").select(F.col("file").alias("path"), F.lit(True).alias("skip"))
    alone = ends.where("NOT target").join(counts.withColumn("full", F.lit(True)).drop("n"), "path", "left").where("kind <> 'dir' OR full IS NULL").join(excluded, "path", "left")
    alone = alone.select("arg", "kind", "path", (F.col("kind") == "file").alias("is_file"), "module", "lang", F.coalesce("skip", F.lit(False)).alias("skip"))
    rows = _matched(inner.unionByName(alone), rules, "side_from").join(_widened(rules, paths, "side_from"), "module", "left")
    bare = F.col("kind") == "module"
    wide = F.when(bare, F.coalesce("wide", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns({"wide": wide, "path": F.when(F.col("module").isNull(), F.col("path"))})
    return rows.groupBy("arg", "kind", "is_file", "module", "lang", "skip", "hits", "wide").agg(F.min("path").alias("path"))


def targets(ends: DataFrame, tree: DataFrame, rules: DataFrame, paths: DataFrame, public: DataFrame) -> DataFrame:
    """(arg, kind, path, module, hits, wide, public) of each target; a directory is covered through its files as well."""
    to = ends.where("target").drop("target", "lang")
    files = tree.select("dir", "file", "excluded")
    counts = tree.groupBy("dir").agg(F.count_if(~F.col("excluded")).alias("n"))
    within = to.where("kind = 'dir'").alias("d").join(files.join(counts, "dir").where("NOT excluded OR n = 0").alias("t"), F.col("d.path") == F.col("t.dir")).select("arg", "module", F.col("file").alias("path"), F.lit(True).alias("is_file"))
    each = to.where("kind <> 'library'").select("arg", "module", "path", (F.col("kind") == "file").alias("is_file")).unionByName(within)
    hit = _matched(each, rules, "side_to").select("arg", F.explode("hits").alias("h")).groupBy("arg", "h.pos").agg(F.min("h.place").alias("place"))
    hit = hit.groupBy("arg").agg(F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("hits"))
    declared = public.groupBy("module").agg(F.collect_set("regex").alias("globs"))
    shown = F.exists("globs", lambda g: F.coalesce(F.rlike(F.col("path"), g) | (F.col("is_file") & F.rlike(directory(F.col("path")), g)), F.lit(False)))
    seen = each.join(F.broadcast(declared), "module", "left").groupBy("arg").agg(F.bool_or(F.col("globs").isNull() | F.col("path").isNull() | shown).alias("public"))
    rows = to.join(hit, "arg", "left").join(seen, "arg", "left").join(_widened(rules, paths, "side_to"), "module", "left")
    none = F.array().cast("array<int>")
    return rows.select("arg", "kind", "path", "module", F.coalesce("hits", F.array().cast("array<struct<pos:int,place:int>>")).alias("hits"), F.when(F.col("kind") == "module", F.coalesce("wide", none)).otherwise(none).alias("wide"), F.coalesce("public", F.lit(True)).alias("public"))


def _places(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["pos"])


def _name(side: Column, hits: Column, pos: Column) -> Column:
    at = F.get(F.filter(hits, lambda h: h["pos"] == pos), F.lit(0))["place"]
    return F.get(side, at - 1)["name"]


def _errors(modes: dict[str, str], least: int) -> Column:
    """The errors of one importer profile (f) and target (t), in the judge's order."""
    f, t = F.col("f.module"), F.col("t.module")
    between = f.isNotNull() & t.isNotNull() & (f != t)
    target = F.coalesce(t, F.col("t.path"))

    def built(rule, test, what, own=False):
        fields = [F.lit(rule), F.lit(False), target, what, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(modes[rule] != "ask"), F.lit(True), F.lit(True), F.lit(False)]
        return F.when(between & test, F.struct(*fields).cast(_ERROR)) if modes[rule] != "off" else F.lit(None).cast(_ERROR)

    reach = F.when(F.col("t.public"), "the public part scores below the least balance").otherwise("past the public part")
    built_in = F.array_compact(F.array(
        built("graph", ~F.array_contains("f_targets", t), F.lit("not an allowed dependency")),
        built("coupling", F.col("balance") < least, reach),
        built("layers", F.col("f_layer") < F.col("t_layer"), F.lit("against the order of layers")),
    ))
    library = F.col("t.kind") == "library"

    def deny(r):
        fields = [r["id"], F.lit(True), target, F.concat(_name(r["side_from"], F.col("f.hits"), r["pos"]), F.lit(" -/-> "), _name(r["side_to"], F.col("t.hits"), r["pos"])), r["why"], r["instead"], F.lit(True), F.lit(True)]
        narrow = F.array_contains(_places(F.col("f.hits")), r["pos"]) & F.array_contains(_places(F.col("t.hits")), r["pos"])
        return F.struct(*fields, narrow, F.lit(False)).cast(_ERROR)

    def denies(r):
        a, b = (F.array_contains(_places(F.col(f"{s}.hits")), r["pos"]) | F.array_contains(F.col(f"{s}.wide"), r["pos"]) for s in "ft")
        return (r["form"] == "deny") & ~library & a & b

    def reads(r):
        def by(lang: str) -> Column:
            below = lambda e: ~e["exact"] & F.startswith(F.col("t.path"), F.concat(e["root"], F.lit(SEPARATORS[lang])))
            entry = lambda e: F.coalesce(e["lang"] == lang, F.lit(True)) & ((F.col("t.path") == e["root"]) | below(e))
            return F.coalesce(F.col("f.lang") == lang, F.lit(True)) & F.exists(r["entries"], entry)

        return (r["form"] == "only") & library & reduce(Column.__or__, map(by, SEPARATORS))

    def only(r):
        inside = F.array_contains(F.col("f.wide"), r["pos"])
        open_ = F.col("f.lang").isNull() & ~F.col("f.is_file") & (F.col("t.path") != r["library"])
        names = F.array_join(F.transform(r["side_from"], lambda n: n["name"]), ", ")
        return F.struct(r["id"], F.lit(True), r["library"], F.concat(F.lit("only for "), names), r["why"], r["instead"], F.lit(True), ~inside, F.lit(True), open_).cast(_ERROR)

    custom = F.transform(F.filter("rules", lambda r: denies(r) | (reads(r) & ~F.array_contains(_places(F.col("f.hits")), r["pos"]))), lambda r: F.when(r["form"] == "deny", deny(r)).otherwise(only(r)))
    return F.concat(built_in, custom)


def can(questions: DataFrame, files: DataFrame, paths: DataFrame, modules: DataFrame, depends_on: DataFrame, public: DataFrame, rules: DataFrame, go_modules: DataFrame | None = None, covered: DataFrame | None = None, modes: dict[str, str] | None = None, min_balance: int = MIN_BALANCE) -> DataFrame:
    """The columns of ANSWER for each question.

    questions: id, from, to; files: file, class; paths: a paths table; modules: module, volatility, subdomain, layer_pos;
    public: module, regex; rules: a rules table; covered: rule, from, to of exceptions that hold (a null to: any).
    """
    modes = MODES | (modes or {})
    # four steps read the questions: they are made once
    asked = cut(questions.select("id", F.nullif(F.col("from"), F.lit("")).alias("a"), F.nullif(F.col("to"), F.lit("")).alias("b")), "can-asked")
    args = asked.select(F.col("a").alias("arg"), F.lit(False).alias("target")).unionByName(asked.select(F.col("b").alias("arg"), F.lit(True).alias("target"))).where("arg IS NOT NULL")
    tree = cut(tree_of(files, paths), "can-tree")
    ends = cut(sides(args, tree, modules, paths, go_modules), "can-ends")
    f, t = importers(ends, tree, rules, paths), targets(ends, tree, rules, paths, public)
    vol = F.coalesce("volatility", F.when(F.lower("subdomain") == "core", "high").when(F.lower("subdomain").isin("supporting", "generic"), "low"), F.lit("high"))
    to_of = depends_on.groupBy("module").agg(F.collect_set("target").alias("targets"))
    m = modules.select("module", vol.alias("v"), F.col("layer_pos").alias("layer")).join(to_of, "module", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))

    def of(side: DataFrame, p: str) -> DataFrame:
        fields = m.select(F.col("module").alias(f"{p}_module"), *(F.col(c).alias(f"{p}_{c}") for c in ("v", "layer", "targets")))
        rows = side.select(F.struct(*side.columns).alias(p))
        return rows.join(fields, F.col(f"{p}.module") == F.col(f"{p}_module"), "left").drop(f"{p}_module")

    f_side = of(f, "f").withColumn("a", F.col("f.arg"))
    t_side = of(t, "t").withColumn("b", F.col("t.arg"))
    every = rules.select(F.struct(*rules.columns).alias("r")).agg(F.array_sort(F.collect_list("r"), lambda x, y: x["pos"] - y["pos"]).alias("rules"))
    both = asked.where("a IS NOT NULL AND b IS NOT NULL").join(f_side, "a").join(t_side, "b").crossJoin(F.broadcast(every))
    between = F.col("f.module").isNotNull() & F.col("t.module").isNotNull() & (F.col("f.module") != F.col("t.module"))
    v = F.when(F.col("t.public"), F.col("t_v")).otherwise(worse_volatility(F.col("t_v"), F.col("f_v")))
    both = both.withColumn("balance", F.when(between, balance(F.when(F.col("t.public"), "contract").otherwise("functional"), F.lit("cross_module"), v).cast("int")))
    both = both.withColumn("errors", _errors(modes, min_balance))
    if covered is not None:
        held = covered.groupBy(F.col("from").alias("_from")).agg(F.collect_set(F.struct("rule", "to")).alias("_held"))
        free = F.filter("errors", lambda e: ~F.exists(F.coalesce("_held", F.array().cast("array<struct<rule:string,to:string>>")), lambda h: (h["rule"] == e["rule"]) & (h["to"].isNull() | (h["to"] == e["to"]))))
        both = both.join(F.broadcast(held), F.col("f.module") == F.col("_from"), "left").withColumn("errors", free)
    sure = F.filter("errors", lambda e: e["sure"] & e["narrow"] & ~e["lang"])
    rank = F.transform(sure, lambda e, i: F.struct(F.when(e["instead"].isNotNull(), 0).when(e["fix"], 1).otherwise(2).alias("r"), i.alias("i"), e.alias("e")))
    # the order of (r, i) is total, so the rest of the struct is never compared
    both = both.withColumns({"no": F.array_min(rank)["e"], "spoken": F.try_element_at(F.filter("errors", lambda e: e["lang"]), F.lit(1)), "open": F.try_element_at(F.filter("errors", lambda e: ~(e["sure"] & e["narrow"])), F.lit(1))})
    a, b = F.col("a"), F.col("b")
    lost = [F.when((F.col("f.module").isNull()), a), F.when((F.col("t.kind") != "library") & F.col("t.module").isNull(), b)]
    homeless = F.coalesce(*lost)
    from_file, to_file = F.concat(F.lit("ask for a file of "), a), F.concat(F.lit("ask for a file of "), b)
    bare = (F.col("f.kind") == "module")
    text = F.lit(None).cast("string")
    case = [
        (F.col("f.skip"), "yes", None, text, text),
        (homeless.isNotNull(), "unknown", None, F.concat(homeless, F.lit(" is in no module")), F.concat(F.lit("rules for "), homeless)),
        (F.col("no").isNotNull(), "no", F.col("no"), F.col("no.what"), F.when(F.col("no.fix"), "fix").otherwise("request")),
        (F.col("spoken").isNotNull(), "unknown", F.col("spoken"), F.concat(F.lit("the rule reads the library by the language of "), a), from_file),
        (F.col("open").isNotNull(), "unknown", F.col("open"), F.concat(F.lit("the rule names paths and a module is asked for: "), F.when(bare, a).otherwise(b)), F.when(bare, from_file).otherwise(to_file)),
        (F.lit(True), "yes", None, text, text),
    ]

    def choose(k):
        out = F
        for c in case:
            out = out.when(c[0], k(c))
        return out

    none = F.lit(None).cast("string")
    one = F.struct(
        choose(lambda c: F.lit(c[1])).alias("answer"), choose(lambda c: none if c[2] is None else c[2]["rule"]).alias("rule"), choose(lambda c: c[3]).alias("what"),
        choose(lambda c: c[2]["why"] if c[1] == "no" else none).alias("why"), choose(lambda c: c[2]["instead"] if c[1] == "no" else none).alias("instead"),
        F.when(~F.col("f.skip") & homeless.isNull() & (F.col("no").isNull() | F.col("no.rule").isin("graph", "coupling")) & F.col("spoken").isNull() & (F.col("no").isNotNull() | F.col("open").isNull()), F.col("balance")).alias("balance"),
        choose(lambda c: c[4]).alias("next"),
    )
    label = F.when(F.col("f.kind") == "dir", None).otherwise(F.col("f.module"))
    said = both.select("id", "a", "b", label.alias("f_label"), F.coalesce(F.col("t.module"), b).alias("to"), one.alias("x"))
    # the files of a directory agree where the least and the greatest answer are one
    by = said.groupBy("id", "a", "b").agg(F.min("f_label").alias("f_label"), F.min("to").alias("to"), F.min("x").alias("x"), F.max("x").alias("y"))
    differ = F.struct(F.lit("unknown").alias("answer"), none.alias("rule"), F.concat(F.lit("the files of "), a, F.lit(" answer differently")).alias("what"), none.alias("why"), none.alias("instead"), F.lit(None).cast("int").alias("balance"), from_file.alias("next"))
    by = by.withColumn("x", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(differ))
    own = ends.where("NOT target AND kind = 'dir'").select(F.col("arg").alias("a"), F.col("module").alias("own"))
    answers = by.join(own, "a", "left").select("id", "a", "b", F.coalesce("f_label", "own", "a").alias("from"), "to", "x")
    out = asked.join(answers.select("id", F.col("a"), F.col("b"), "from", "to", "x").distinct(), ["id", "a", "b"], "left")
    return out.select("id", F.coalesce("from", "a").alias("from"), F.coalesce("to", "b").alias("to"), "x.answer", "x.rule", F.coalesce("x.what", F.when(a.isNull() | b.isNull(), "name both sides")).alias("what"), "x.why", "x.instead", "x.balance", "x.next")
