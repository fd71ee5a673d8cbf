"""Completeness of evidence: which facts a dimension needs, how far it is measured, what to warn of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimension, facts in its claim, facts outside it.
FACTS = {
    "intent": (["declared intent inventory"], []),
    "structure": (["primary dependency inventory", "internal edge classification"], ["external dependency structure"]),
    "modularity": (["declared module inventory", "module boundary attribution", "module graph shape"], ["inferred public surface"]),
    "coupling": (["coupling candidate inventory", "coupling strength", "coupling distance", "coupling volatility", "extractor resolution within ceiling"], ["local and undeclared-external coupling"]),
    "change_locality": (["eligible commit sample", "commit-to-module attribution"], ["essential vs accidental volatility"]),
    "complexity": (["declared module graph", "dependency chain depth", "module fan-in distribution", "module fan-out distribution"], ["code size tail", "function length distribution", "cognitive complexity"]),
    "testability": (["production source inventory", "supplied coverage units", "coverage path resolution", "coverage module attribution", "coverage freshness"], ["assertion quality", "boundary test semantics"]),
    "operations": (["declared operational topology", "corroborated deploy unit", "owner provenance", "declared-to-corroborated topology reconciliation"], ["observed runtime topology", "supply-chain inventory", "analyzer health"]),
    "drift": (["admissible persisted reference", "complete two-sided seam identity"], ["base comparison"]),
}
BANDS = ["critical", "poor", "mixed", "serviceable", "strong"]
LADDER = [("same_module", 2), ("cross_module", 9), ("different_owner", 9), ("different_deploy_unit", 9), ("external", 10)]


def promoted(subjects: DataFrame, seen: DataFrame) -> DataFrame:
    """(subject, dimension, status, missing): subjects (subject), seen (subject, dimension, fact, applies).

    A fact that is observed (applies) or proved not applicable is not missing; `measured` with none missing, `partial` with
    one of the claim observed, else `unmeasured`.  Facts outside the claim never count; missing ones are named in order."""
    spark = subjects.sparkSession
    need = spark.createDataFrame([(d, f, k) for d, (claim, _) in FACTS.items() for k, f in enumerate(claim)], "dimension string, fact string, pos int")
    per = need.groupBy("dimension").agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("need"))
    got = seen.join(need.drop("pos"), ["dimension", "fact"], "left_semi").groupBy("subject", "dimension").agg(F.collect_set("fact").alias("got"), F.coalesce(F.bool_or("applies"), F.lit(False)).alias("some"))
    rows = subjects.select("subject").distinct().join(F.broadcast(per), how="cross").join(got, ["subject", "dimension"], "left")  # nine rows a subject
    missing = F.array_except(F.transform("need", lambda x: x["fact"]), F.coalesce("got", F.array().cast("array<string>")))
    return rows.select("subject", "dimension", F.when(F.size(missing) == 0, "measured").when(F.col("some"), "partial").otherwise("unmeasured").alias("status"), F.array_join(missing, "; ").alias("missing"))


def band(score: Column) -> Column:
    """Band of a score from 0 to 10."""
    return F.when(score >= 9, "strong").when(score >= 7, "serviceable").when(score >= 5, "mixed").when(score >= 3, "poor").otherwise("critical")


def capped(of: Column, confidence: Column) -> Column:
    """A band no better than its confidence allows: all with high, serviceable with medium, else mixed."""
    place = F.array(*map(F.lit, BANDS))
    most = F.when(confidence == "high", 5).when(confidence == "medium", 4).otherwise(3)
    return F.element_at(place, F.least(F.greatest(F.array_position(place, of), F.lit(1)), most).cast("int"))


def health(facts: DataFrame) -> DataFrame:
    """(subject, warning) from (subject, gaps, total, scored, abstained, external, same_module, python_ok, files_owned, declared)."""
    total, scored = F.col("total"), F.col("scored")
    found = F.array(
        F.when(F.col("gaps") > 0, "coverage gap"),
        F.when((total > 0) & (scored == 0), "no edge scored"),
        F.when((scored == 0) & (F.col("abstained") > 0) & (F.col("external") == 0), "strength unknown everywhere"),
        F.when(F.col("python_ok") & (F.col("external") > 0) & (scored == 0) & (total - F.col("same_module") == F.col("external")), "no internal edges"),
        F.when((F.col("files_owned") == 0) & F.col("declared"), "no file in a declared module"),
    )
    return facts.select("subject", F.explode(F.filter(found, lambda w: w.isNotNull())).alias("warning"))
