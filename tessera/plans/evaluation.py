"""Ownership, timelines, text facts and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import text as T
from .registry import Facts, query

DAY = "CAST(ts AS DATE)"
PAIRS = "(SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS idx, CAST(user_id % 97 AS BIGINT) AS a, event_type AS b FROM events)"


def pairs(f: Facts):
    return f.events.select(F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01"))).alias("idx"), (F.col("user_id") % 97).alias("a"), F.col("event_type").alias("b")).distinct()


@query("presence_intervals", f"WITH k AS (SELECT *, idx - row_number() OVER (PARTITION BY a, b ORDER BY idx) AS g FROM {PAIRS} p) SELECT a, b, min(idx)::INT AS opened, max(idx)::INT AS closed, count(*)::BIGINT AS units FROM k GROUP BY a, b, g")
def presence_intervals(f):
    k = pairs(f).withColumn("g", F.col("idx") - F.row_number().over(Window.partitionBy("a", "b").orderBy("idx")))
    return k.groupBy("a", "b", "g").agg(F.min("idx").alias("opened"), F.max("idx").alias("closed"), F.count("*").alias("units")).drop("g")


@query("first_appearance", f"SELECT a, b, min(idx)::INT AS first_unit FROM {PAIRS} p GROUP BY a, b")
def first_appearance(f):
    return pairs(f).groupBy("a", "b").agg(F.min("idx").alias("first_unit"))


@query("freeze_requests", f"WITH z AS (SELECT DISTINCT a, b FROM {PAIRS} p WHERE idx <= 3), n AS (SELECT a, b, min(idx) AS idx FROM {PAIRS} p GROUP BY a, b) SELECT (idx // 7)::INT AS week, count(*)::BIGINT AS requests FROM n ANTI JOIN z USING (a, b) GROUP BY 1")
def freeze_requests(f):
    p = pairs(f)
    frozen = p.where("idx <= 3").select("a", "b").distinct()
    later = p.groupBy("a", "b").agg(F.min("idx").alias("idx")).join(frozen, ["a", "b"], "left_anti")
    return later.groupBy(F.expr("cast(idx div 7 AS INT)").alias("week")).agg(F.count("*").alias("requests"))


@query("asof_cutoff", "SELECT u.user_id, c.cutoff, max_by(event_id, epoch_us(ts) * 1) AS event_id FROM (VALUES (DATE '2024-01-08'), (DATE '2024-01-15'), (DATE '2024-01-25')) c(cutoff) JOIN events u ON CAST(ts AS DATE) <= cutoff GROUP BY ALL")
def asof_cutoff(f):
    cutoffs = f.spark.createDataFrame([("2024-01-08",), ("2024-01-15",), ("2024-01-25",)], "cutoff string").select(F.to_date("cutoff").alias("cutoff"))
    e = f.events.select("user_id", "event_id", "ts")
    return e.join(cutoffs, F.col("ts").cast("date") <= F.col("cutoff")).groupBy("user_id", "cutoff").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("copy_events", "WITH l AS (SELECT * FROM {:literals} x) SELECT a.value, a.file, min(b.module) AS other_module, count(DISTINCT b.module)::BIGINT AS holders FROM l a JOIN l b ON a.value = b.value AND a.module <> b.module WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY ALL")
def copy_events(f):
    # per value: the modules that held it before; the added side joins that one row, never all pairs
    v = f.literals
    before = v.where("doc_id % 2 = 0").groupBy("value").agg(F.collect_set("module").alias("m"))
    new = v.where("doc_id % 2 = 1").select("value", "file", "module").distinct().join(before, "value")
    other = F.array_sort(F.filter("m", lambda x: x != F.col("module")))
    return new.withColumn("o", other).where("size(o) > 0").select("value", "file", F.col("o")[0].alias("other_module"), F.size("o").cast("long").alias("holders"))


@query("equivalence", "WITH a AS (SELECT DISTINCT from_module, to_module FROM {:uses} u WHERE qty < 40), b AS (SELECT DISTINCT from_module, to_module FROM {:uses} u WHERE qty > 12) SELECT from_module, to_module, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT from_module, to_module, 'only_reference' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT from_module, to_module, 'only_new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def equivalence(f):
    a = f.uses.where("qty < 40").select("from_module", "to_module").distinct().withColumn("x", F.lit(True))
    b = f.uses.where("qty > 12").select("from_module", "to_module").distinct().withColumn("y", F.lit(True))
    return a.join(b, ["from_module", "to_module"], "full").select("from_module", "to_module", F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), "only_reference").otherwise("only_new").alias("side"))


@query("dominant_author", "WITH k AS (SELECT l_partkey % 40 AS module, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY ALL) SELECT module, arg_min(author, -n * 1000000 + author) AS author, max(n)::BIGINT AS touches FROM k GROUP BY module")
def dominant_author(f):
    k = f.lineitem.groupBy((F.col("l_partkey") % 40).alias("module"), F.col("l_suppkey").alias("author")).agg(F.count("*").alias("n"))
    return k.groupBy("module").agg(F.min_by("author", F.struct(-F.col("n"), "author")).alias("author"), F.max("n").alias("touches"))


@query("dominant_kind", "WITH k AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind) AS r FROM k) SELECT user_id, kind, n::BIGINT AS sites FROM r WHERE r = 1")
def dominant_kind(f):
    k = f.events.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return k.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("m")).select("user_id", "m.kind", (-F.col("m.n")).alias("sites"))


@query("runtime_edges", "WITH k AS (SELECT user_id % 7 AS module, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY event_id) AS r FROM events) SELECT module, kind, count(*)::BIGINT AS edges, string_agg(CASE WHEN r <= 5 THEN event_id::STRING END, ',' ORDER BY r) AS sample FROM k GROUP BY module, kind")
def runtime_edges(f):
    k = f.events.select((F.col("user_id") % 7).alias("module"), F.col("event_type").alias("kind"), "event_id")
    first = k.withColumn("r", F.row_number().over(Window.partitionBy("module", "kind").orderBy("event_id"))).where("r <= 5")
    sample = first.groupBy("module", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return k.groupBy("module", "kind").agg(F.count("*").alias("edges")).join(sample, ["module", "kind"])


@query("signals_union", "SELECT 'runtime' AS source, user_id % 7 AS module, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' GROUP BY ALL UNION ALL SELECT 'dynamic', l_suppkey % 7, count(*)::BIGINT FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def signals_union(f):
    a = f.events.where("event_type = 'click'").groupBy((F.col("user_id") % 7).alias("module")).agg(F.count("*").alias("n")).withColumn("source", F.lit("runtime"))
    b = f.lineitem.where("l_returnflag = 'R'").groupBy((F.col("l_suppkey") % 7).alias("module")).agg(F.count("*").alias("n")).withColumn("source", F.lit("dynamic"))
    return a.unionByName(b).select("source", "module", "n")


@query("fill_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author FROM events")
def fill_forward(f):
    return T.carried(f.events.select("event_id", F.when(F.col("event_type") == "signup", F.col("user_id")).alias("author")), "event_id", "author")


@query("first_source_wins", "WITH s AS (SELECT p_brand AS module, 'manifest' AS source, 0 AS priority, min(p_type) AS unit FROM part WHERE p_size < 3 GROUP BY p_brand UNION ALL SELECT p_brand, 'image', 1, max(p_type) FROM part WHERE p_size < 30 GROUP BY p_brand UNION ALL SELECT p_brand, 'cluster', 2, p_brand FROM part GROUP BY p_brand) SELECT module, arg_min(source, priority) AS source, arg_min(unit, priority) AS unit FROM s GROUP BY module")
def first_source_wins(f):
    p = f.part
    a = p.where("p_size < 3").groupBy("p_brand").agg(F.min("p_type").alias("unit")).select("p_brand", F.lit("manifest").alias("source"), F.lit(0).alias("priority"), "unit")
    b = p.where("p_size < 30").groupBy("p_brand").agg(F.max("p_type").alias("unit")).select("p_brand", F.lit("image").alias("source"), F.lit(1).alias("priority"), "unit")
    c = p.select("p_brand").distinct().select("p_brand", F.lit("cluster").alias("source"), F.lit(2).alias("priority"), F.col("p_brand").alias("unit"))
    return a.unionByName(b).unionByName(c).groupBy(F.col("p_brand").alias("module")).agg(F.min_by("source", "priority").alias("source"), F.min_by("unit", "priority").alias("unit"))


HINT = "CASE hint WHEN 'contract' THEN 1 WHEN 'model' THEN 2 WHEN 'functional' THEN 3 WHEN 'symmetric' THEN 4 WHEN 'intrusive' THEN 5 ELSE 0 END"


@query("hint_fold", f"SELECT from_module, to_module, arg_max(hint, {HINT}) AS hint, count(*)::BIGINT AS edges FROM {{:edges}} e GROUP BY ALL")
def hint_fold(f):
    from ..functions.columns import STRENGTH_RANK, pick

    return f.edges.groupBy("from_module", "to_module").agg(F.max_by("hint", pick(F.col("hint"), STRENGTH_RANK, 0)).alias("hint"), F.count("*").alias("edges"))


def files(f: Facts):
    return f.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")


@query("file_loc", "SELECT 'd' || doc_id AS file, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS loc FROM documents")
def file_loc(f):
    return files(f).select("file", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("loc"))


@query("literal_scan", """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS content FROM pages) SELECT page_id, value, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(content, '"([^"\\n]*)"', 1)) AS value FROM l) GROUP BY ALL""")
def literal_scan(f):
    p = f.pages.select(F.col("page_id").alias("file"), "html")
    return T.literals(p, "html").groupBy(F.col("file").alias("page_id"), "value").agg(F.count("*").alias("n"))


@query("added_lines", "SELECT 'd' || doc_id AS file, unnest([doc_id % 50 + 2, doc_id % 50 + 4, doc_id % 9 + 100])::BIGINT AS line FROM documents")
def added_lines(f):
    a, b = (F.col("doc_id") % 50 + 1).cast("string"), (F.col("doc_id") % 9 + 100).cast("string")
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,3 +"), a, F.lit(",4 @@ f()\n same\n+one\n-gone\n same\n++++ two\n@@ -90 +"), b, F.lit(" @@\n-old\n+three\n\\ No newline at end of file"))
    return T.added_lines(f.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), diff.alias("text")))


@query("file_facts", "WITH r AS (SELECT DISTINCT a.p_brand AS from_module, b.p_brand AS to_module, a.p_partkey AS f FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey WHERE a.p_brand <> b.p_brand) SELECT p_brand AS module, count(*)::BIGINT AS files, max(o.out_degree) AS out_degree, max(i.fan_in) AS fan_in FROM part LEFT JOIN (SELECT from_module, count(DISTINCT to_module)::BIGINT AS out_degree FROM r GROUP BY 1) o ON o.from_module = p_brand LEFT JOIN (SELECT to_module, count(DISTINCT from_module)::BIGINT AS fan_in FROM r GROUP BY 1) i ON i.to_module = p_brand GROUP BY p_brand")
def file_facts(f):
    p = f.part.select("p_partkey", "p_brand")
    li = f.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select("l_orderkey", "l_linenumber", "p_brand")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_brand").alias("to_module"))
    r = li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("p_brand").alias("from_module"), "to_module").where("from_module <> to_module").distinct()
    o = r.groupBy(F.col("from_module").alias("module")).agg(F.count("*").alias("out_degree"))
    i = r.groupBy(F.col("to_module").alias("module")).agg(F.count("*").alias("fan_in"))
    return p.groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("files")).join(o, "module", "left").join(i, "module", "left")


@query("sanitize_text", r"SELECT doc_id, left(regexp_replace(regexp_replace(chr(27) || '[31m' || text || chr(7) || chr(27) || '[0m', '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), '[\x00-\x1f\x7f]+', ' ', 'g'), 200) AS clean FROM documents")
def sanitize_text(f):
    esc = F.char(F.lit(27))
    return f.documents.select("doc_id", T.sanitized(F.concat(esc, F.lit("[31m"), "text", F.char(F.lit(7)), esc, F.lit("[0m"))).alias("clean"))


@query("sarif_rows")
def sarif_rows(f):
    from .changes import head_errors

    e = head_errors(f)
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat("from", F.lit(" must not use "), "to").alias("text"))
    return e.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.lit("error").alias("level"), message.alias("message"), F.array(where).alias("locations"))).alias("result"))


@query("stratified_sample", "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, n::BIGINT AS stratum, round(n / least(n, 20), 6) AS weight FROM k WHERE r <= 20")
def stratified_sample(f):
    d = f.documents.select("doc_id", "lang", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("h"))
    size = d.groupBy("lang").agg(F.count("*").alias("stratum"))
    top = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where("r <= 20")
    return top.join(size, "lang").select("doc_id", "lang", "stratum", F.round(F.col("stratum") / F.least("stratum", F.lit(20)), 6).alias("weight"))


WILSON = "(p + z * z / (2 * n) {} z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)"


@query("weighted_precision", f"WITH k AS (SELECT source, count(*) AS n, sum(quality) / count(*) AS p, sum(n_chars * quality) / sum(n_chars) AS w, pow(sum(n_chars), 2) / sum(n_chars * n_chars) AS e, 1.96 AS z FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, n::BIGINT AS n, round(w, 6)::DOUBLE AS weighted, round(e, 6)::DOUBLE AS effective_n, round({WILSON.format('-')}, 6)::DOUBLE AS low, round({WILSON.format('+')}, 6)::DOUBLE AS high FROM k")
def weighted_precision(f):
    k = f.labels.join(f.documents.select("doc_id", "source", F.col("n_chars").cast("double").alias("c")), "doc_id").groupBy("source").agg(F.count("*").alias("n"), (F.sum("quality") / F.count("*")).alias("p"), (F.sum(F.col("c") * F.col("quality")) / F.sum("c")).alias("w"), (F.pow(F.sum("c"), F.lit(2)) / F.sum(F.col("c") * F.col("c"))).alias("e"))
    k = k.withColumn("z", F.lit(1.96))
    return k.select("source", "n", F.round("w", 6).alias("weighted"), F.round("e", 6).alias("effective_n"), F.round(F.expr(WILSON.format("-")), 6).alias("low"), F.round(F.expr(WILSON.format("+")), 6).alias("high"))
