"""Configuration by directory.  Regions, nations and suppliers are directories; a supplier's options extend its nation's, and those its region's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import config
from .registry import Facts, query

PLACE = "SELECT 'r' || r_regionkey AS r, 'r' || r_regionkey || '/n' || n_nationkey AS n, 'r' || r_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS s, r_regionkey, n_nationkey, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def places(f: Facts):
    s = f.supplier.join(f.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(f.region, F.col("n_regionkey") == F.col("r_regionkey"))
    r = F.concat(F.lit("r"), "r_regionkey")
    n = F.concat(r, F.lit("/n"), "n_nationkey")
    return s.select(r.alias("r"), n.alias("n"), F.concat(n, F.lit("/s"), "s_suppkey").alias("s"), "r_regionkey", "n_nationkey", "s_suppkey", "s_acctbal")


def files(f: Facts):
    p = places(f)
    name = F.lit("/tsconfig.json")
    first = p.where("r_regionkey = 0").groupBy("r").agg(F.min_by("n", "n_nationkey").alias("n"))  # its region extends this nation, a circle
    region = p.select("r").distinct().join(first, "r", "left").select(F.concat("r", name).alias("file"), F.concat(F.lit('{ // "a region"\n'), F.coalesce(F.concat(F.lit('"extends": "../'), "n", name, F.lit('", ')), F.lit("")), F.lit('"compilerOptions": {"baseUrl": "./lib",}}')).alias("text"))
    nation = p.select("n", "n_nationkey").distinct().select(F.concat("n", name).alias("file"), F.concat(F.lit('{"extends": ["../tsconfig.json"], /* aliases */ "compilerOptions": {"paths": {"@n/*": ["x'), "n_nationkey", F.lit('/*"]}}}')).alias("text"))
    own = F.when(F.col("s_acctbal") < 0, ', "compilerOptions": {"baseUrl": "own"}').otherwise("")
    supplier = p.select(F.concat("s", name).alias("file"), F.concat(F.lit('{"extends": "../tsconfig"'), own, F.lit("}")).alias("text"))
    return region.unionByName(nation).unionByName(supplier)


@query("compiler_options", f"""WITH p AS ({PLACE}), ring AS (SELECT arg_min(n, n_nationkey) AS n FROM p WHERE r_regionkey = 0), base AS (SELECT p.*, ring.n IS NOT NULL AS cut FROM p LEFT JOIN ring ON ring.n = p.n)
SELECT s || '/tsconfig.json' AS file, CASE WHEN s_acctbal < 0 THEN s || '/own' WHEN NOT cut THEN r || '/lib' END AS base_url, '@n/*=' || CASE WHEN cut THEN n WHEN s_acctbal < 0 THEN n ELSE n END || '/x' || n_nationkey || '/*' AS aliases, NULL AS problem FROM base
UNION ALL SELECT DISTINCT n || '/tsconfig.json', CASE WHEN NOT cut THEN r || '/lib' END, '@n/*=' || n || '/x' || n_nationkey || '/*', CASE WHEN cut THEN 'extends itself in a circle' END FROM base
UNION ALL SELECT DISTINCT r || '/tsconfig.json', r || '/lib', '', CASE WHEN r_regionkey = 0 THEN 'extends itself in a circle' END FROM base""")
def compiler_options(f):
    got, problems = config.inherited(config.compiler_options(files(f)))
    shown = F.array_join(F.transform(F.coalesce("aliases", F.array().cast(config.ALIASES)), lambda a: F.concat(a["pattern"], F.lit("="), F.array_join(a["into"], ";"))), ",")
    return got.join(problems, "file", "left").select("file", "base_url", shown.alias("aliases"), "problem")


@query("workspace_members", f"""WITH p AS ({PLACE}) SELECT DISTINCT s || '/f' || l_linenumber || '.go' AS file, CASE WHEN s_acctbal >= 0 THEN s END AS member FROM lineitem JOIN p ON l_suppkey = s_suppkey""")
def workspace_members(f):
    p = places(f)
    line = F.concat(F.lit("\t./s"), F.col("s_suppkey").cast("string"), F.lit(" // a member"))
    work = p.where("s_acctbal >= 0").groupBy("n").agg(F.concat(F.lit("go 1.22\n\nuse (\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n)\n")).alias("text")).select(F.concat("n", F.lit("/go.work")).alias("file"), "text")
    sources = f.lineitem.select("l_suppkey", "l_linenumber").distinct().join(p, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat("s", F.lit("/f"), "l_linenumber", F.lit(".go")).alias("file"))
    return config.member_of(sources, config.go_members(work))
