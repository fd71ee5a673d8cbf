"""The rules of a policy over uses, one function a rule; each returns errors (rule, from, to, file, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import balance, worse_volatility
from .uses import ancestors, named

#: Shapes of literals (fixed values).
TAG, TOKEN = r'^([\p{L}\p{N}_]+:"[^"]*"\s*)+$', r"^[\p{L}\p{N}_.:@-]+$"
ORDER = ["graph", "coupling", "duplication", "cycle", "layers", "unowned"]


def errors(uses: DataFrame, rule: str | Column, a: str = "from_module", b: str = "to_module") -> DataFrame:
    return uses.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.col(a).alias("from"), F.col(b).alias("to"), "file", "line")


def crossing(uses: DataFrame) -> DataFrame:
    return uses.where("from_module <> to_module")


def graph(uses: DataFrame, depends_on: DataFrame) -> DataFrame:
    allowed = depends_on.select(F.col("module").alias("from_module"), F.col("target").alias("to_module"))
    return errors(crossing(uses).join(allowed, ["from_module", "to_module"], "left_anti"), "graph")


def coupled(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """uses with their balance: contract past a public surface, else functional; functional takes the worse volatility."""
    vol = F.coalesce("volatility", F.when(F.lower("subdomain") == "core", "high").when(F.lower("subdomain").isin("supporting", "generic"), "low"), F.lit("high"))
    m = modules.select("module", vol.alias("v"))
    both = crossing(uses).join(m.withColumnsRenamed({"module": "from_module", "v": "from_v"}), "from_module").join(m.withColumnsRenamed({"module": "to_module", "v": "to_v"}), "to_module")
    both = both.withColumn("strength", F.when(F.col("public"), "contract").otherwise("functional"))
    both = both.withColumn("volatility", F.when(F.col("strength") == "contract", F.col("to_v")).otherwise(worse_volatility(F.col("to_v"), F.col("from_v"))))
    return both.withColumn("balance", balance(F.col("strength"), F.lit("cross_module"), F.col("volatility")).cast("int"))


def coupling(uses: DataFrame, modules: DataFrame, min_balance: int = 7) -> DataFrame:
    return errors(coupled(uses, modules).where(F.col("balance") < min_balance), "coupling")


def layers(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """Dependencies from an inner layer on an outer one."""
    m = modules.select("module", "layer_pos")
    both = crossing(uses).join(m.withColumnsRenamed({"module": "from_module", "layer_pos": "p"}), "from_module").join(m.withColumnsRenamed({"module": "to_module", "layer_pos": "q"}), "to_module")
    return errors(both.where("p < q"), "layers")


def deny(uses: DataFrame, denied: DataFrame, modules: DataFrame) -> DataFrame:
    """denied: (pos, id, from_regex, to_regex).  One error for each use and rule; patterns are resolved once a module, uses join by name."""
    by = named(modules, denied)
    both = crossing(uses).join(by.select(F.col("module").alias("from_module"), "deny_from").where("size(deny_from) > 0"), "from_module").join(by.select(F.col("module").alias("to_module"), "deny_to").where("size(deny_to) > 0"), "to_module")
    hit = both.withColumn("_hit", F.explode(F.array_intersect("deny_from", "deny_to")))
    return errors(hit, F.col("_hit.id"))


def only(uses: DataFrame, allowed: DataFrame) -> DataFrame:
    """allowed: (id, root, in_regex): libraries under root are for some modules alone.  Joined by the leading parts of a library."""
    hit = uses.withColumn("root", F.explode(ancestors(F.col("library")))).join(allowed, "root").where("NOT from_module RLIKE in_regex")
    return hit.select(F.col("id").alias("rule"), F.col("from_module").alias("from"), F.col("root").alias("to"), "file", "line")


def unowned(files: DataFrame) -> DataFrame:
    """files: (file, module, production)."""
    return files.where("production AND module IS NULL").select(F.lit("unowned").alias("rule"), F.col("file").alias("from"), F.lit("").alias("to"), "file", F.lit(0).cast("long").alias("line"))


def duplication(literals: DataFrame, least: int = 12) -> DataFrame:
    """Literals of at least so many characters that exactly two modules hold in production files."""
    own = literals.where((F.length("value") >= least) & (shape(F.col("value")) == "other") & F.col("module").isNotNull() & (F.col("class") == "production"))
    pair = own.groupBy("value").agg(F.array_sort(F.collect_set("module")).alias("m")).where("size(m) = 2")
    return own.join(pair, "value").select(F.lit("duplication").alias("rule"), F.col("m")[0].alias("from"), F.col("m")[1].alias("to"), "file", F.lit(0).cast("long").alias("line"), "value")


def shape(value: Column) -> Column:
    """tag: pairs of a key and a quoted value; word: one token of letters, digits, and a few marks; other."""
    return F.when(value.rlike(TAG), "tag").when(value.rlike(TOKEN), "word").otherwise("other")


def errors_by_key(found: DataFrame) -> DataFrame:
    """(rule, from, to, sites, first_file, first_line): distinct sites of each key."""
    return found.select("rule", "from", "to", "file", "line").distinct().groupBy("rule", "from", "to").agg(F.count("*").alias("sites"), F.min(F.struct("file", "line")).alias("s")).select("rule", "from", "to", "sites", F.col("s.file").alias("first_file"), F.col("s.line").alias("first_line"))


def rank(rule: Column) -> Column:
    out = F.lit(len(ORDER))
    for k, r in enumerate(ORDER):
        out = F.when(rule == r, k).otherwise(out)
    return out
