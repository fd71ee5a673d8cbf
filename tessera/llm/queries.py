"""The contract queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as q12
from . import audit as q13
from . import embeddings as q7
from . import exact as q11
from . import html as q1
from . import langid as q10
from . import licenses as q3
from . import lines as q8
from . import mixing as q6
from . import packing as q9
from . import quality as q4
from . import simhash as q2
from . import token_files as q5
from .common import scratch_path, table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q1.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q2.near_duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return q3.scan(docs).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q4.quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.drop("longest_repeat")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = q5.write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return q5.digest(manifest)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q6.mix(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q7.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q8.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return q9.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return q10.identify(docs, q10.fit(docs))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q11.exact_groups(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return q12.cross_align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q13.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_simhash": op2_simhash, "op3_licenses": op3_licenses, "op4_quality": op4_quality, "op5_token_files": op5_token_files, "op6_mixing": op6_mixing, "op7_embeddings": op7_embeddings, "op8_lines": op8_lines, "op9_packing": op9_packing, "op10_language": op10_language, "op11_exact": op11_exact, "op12_alignment": op12_alignment, "op13_audit": op13_audit}


def _covered(k: int) -> str:
    """Words of each document inside k-word windows found twice or more in it."""
    return f"""
    SELECT doc_id, count(DISTINCT w + o) AS covered FROM (
      SELECT doc_id, w, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (
        SELECT doc_id, unnest(generate_series(1, len(ws) - {k - 1})) AS w,
               unnest(list_transform(generate_series(1, len(ws) - {k - 1}), lambda i: array_to_string(list_slice(ws, i, i + {k - 1}), ' '))) AS win
        FROM words WHERE len(ws) >= {k})
    ), generate_series(0, {k - 1}) AS g(o) WHERE c > 1 GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_exact": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
        "op13_audit": rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(ws) < {q13.MIN_WORDS}, 100 * len(list_distinct(ws)) < {q13.MIN_DISTINCT} * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > {q13.MAX_CAPITALS} * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS f FROM w LEFT JOIN known USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
turns AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, ascii(substr(filter_order, step, 1)) - 64 AS own,
  list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before FROM steps),
replayed AS (SELECT part, filter_order, step, letter, good, toxic, f[own] AS failing, f[own] AND list_sum(list_transform(f, lambda x: x::INT)) = 1 AS only_here,
  step > 1 AND list_bool_or(list_transform(before, lambda k: coalesce(f[k], false))) AS gone FROM fails, turns),
sums AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT failing AND NOT gone) AS kept, count(*) FILTER (failing AND NOT gone) AS removed,
  count(*) FILTER (failing AND gone) AS redundant, count(*) FILTER (only_here) AS unique_fails, count(*) FILTER (failing AND NOT gone AND good) AS good_lost,
  count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost FROM replayed GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM sums""",
        "op7_embeddings": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS ok FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {q7.COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id""",
        "op4_quality": rf"""
WITH words AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
c8 AS ({_covered(q4.BASE_WINDOW)}), c5 AS ({_covered(q4.MIN_WORDS)}), long AS ({_covered(q4.MAX_LONGEST + 1)}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
dup AS (SELECT doc_id, sum(n - 1) AS d FROM (
  SELECT doc_id, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(c8.covered, 0)::BIGINT AS n_repeat_words, coalesce(c5.covered, 0)::BIGINT AS n_covered_words,
  long.covered IS NULL AS short_enough
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
  (n_words < {q4.BASE_MIN_WORDS} OR 100 * n_repeat_words > {q4.BASE_MAX_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {q4.BASE_MIN_WORDS} OR 100 * n_repeat_words > {q4.BASE_MAX_PERCENT} * n_words)
    AND 100 * n_covered_words <= {q4.MAX_PERCENT} * n_words AND short_enough AS kept
FROM m""",
    }
