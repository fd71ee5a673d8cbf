"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import lines, mixing, packing, quality, simhash
from tessera.llm.common import cut, table

#: Shares of the tokens of good and low documents; a document is repeated MOST times at most.
TARGETS, MOST = {"good": 0.85, "low": 0.15, "toxic": 0.0}, 4.0
#: Words whose ids a packing worker remembers, and bytes that it encodes at once: executors have grown by the stages before.
MEMORY, BLOCK = 80_000, 1_500_000
ORACLE_SQL = None  # hashes of shingles, union-find and tokenizers are beyond SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition rules."""
    return quality.quality(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines; documents left without a word go."""
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the first by id, then by a hash of id and text; a null id comes last.

    Rows are told apart by id and text, so rows that share an id are judged one by one, and of repeated rows one stays.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    marks = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = rows.select("doc_id", "_row").join(marks, "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    kept = rows.join(first.hint("shuffle_merge"), "_row", "left_semi")
    copy = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    return kept.withColumn("_copy", copy).where("_copy = 1").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: clean ones once to MOST times, so that good and low meet their target shares; toxic ones go."""
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, most=MOST, keep_clean=True)
    return rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=MEMORY, block=BLOCK)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
