"""Mixing to target weights with soft domain membership, in DataFrame operations alone.

A labelled table gives each of a bounded sample of documents a domain (toxic,
good or low).  Naive Bayes over the most telling words (``MAX_WORDS`` of those
in ``LEAST`` documents or more whose rates differ significantly between domains,
however rare they are) then gives every document a posterior over the
domains.  Rates r minimise sum_d (A_d - T_d)^2 / M_d within their bounds, where
A_d = sum_i r_i t_i p_id is the expected token total of domain d, T_d its target
and M_d its total at rate 1: in the token-weighted metric a step of 1 is safe,
for the posteriors of a document sum to one.  Documents whose posteriors agree to
``1 / GRAIN`` share a rate, so one aggregate of a few thousand rows holds all that
the least squares need; accelerated projected gradient runs on it until no step
within the bounds moves a rate by more than ``TOLERANCE`` (or for ``ROUNDS`` steps).

With ``keep_clean`` no document that is more likely good or low than toxic may
have a rate under 1: targets are then met by repeating documents and by leaving
out toxic ones.  A domain without a labelled document has no target.

Defined results: a null or empty text has no token, the prior as posterior, and
the rate of its neighbours or 1; a document with several labels takes the first
domain by name; documents with equal posteriors have equal rates; with no labelled document the posterior is
uniform; repeated rows are rated one by one; a null id copies as a whole number
by rounding down; extra columns pass through unless they have a result's name.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.85, "low": 0.15, "toxic": 0.0}
SAMPLE, MAX_WORDS, BUCKETS, LEAST, SIGNIFICANT = 20_000, 2_000, 32_768, 5, 4.0
GRAIN, ROUNDS, TOLERANCE = 100, 100_000, 1e-7
#: Documents that the rate over all domains counts as, in the rate of each domain.
SMOOTH = 10.0


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens and _h: hashes of the distinct words of a text, its share of runs of marks and its variety of words, in steps.

    Each step is a column of its own, so that a text is split once.
    """
    out = docs.withColumn("_w", _words(F.col(text)))
    out = out.withColumns({"_k": F.array_distinct("_w"), "n_tokens": F.size("_w").cast("long"), "_m": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[#*$%&|!]+"))})
    marks = F.concat(F.lit("marks "), F.least(F.col("_m") * 4 / F.greatest("n_tokens", F.lit(1)), F.lit(4)).cast("int").cast("string"))
    variety = F.concat(F.lit("variety "), F.when(F.col("n_tokens") > 0, F.floor(10 * F.size("_k") / F.col("n_tokens"))).otherwise(-1).cast("string"))
    out = out.withColumn("_h", F.transform(F.concat("_k", F.array(marks, variety)), lambda x: F.xxhash64(x)))
    return out.drop("_w", "_k", "_m")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?()\"'*#$%&|]+"), lambda w: w != "")


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "low")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[float], dict[int, list[float]], list[bool]]:
    """Log priors, log weights by feature (the most telling of the labelled sample), and which domains have labels."""
    known = labels.select("doc_id", domain().alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = cut(featured(docs.select("doc_id", "text").join(drawn, "doc_id")).select("domain", F.col("_h").alias("h")), "mixing-sample")
    size = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    prior = [math.log((size.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    counts = rows.select("domain", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]).where(F.col("n") >= LEAST)
    telling = []
    for d in DOMAINS:
        own, rest = size.get(d, 0), total - size.get(d, 0)
        p, q, pooled = F.col(d) / (own + 1), (F.col("n") - F.col(d)) / (rest + 1), F.least(F.col("n") / (total + 1), F.lit(0.999))
        telling.append(F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (own + 1) + 1 / (rest + 1))))
    top = counts.withColumn("z", F.greatest(*telling)).where(F.col("z") > SIGNIFICANT).orderBy(F.desc("z"), "h").limit(MAX_WORDS).collect()
    # each rate is drawn towards the rate over all domains, so that a rare chance word says little
    pooled = {r["h"]: r["n"] / (total + 1) for r in top}
    weights = {r["h"]: [round(math.log((r[d] + SMOOTH * pooled[r["h"]]) / (size.get(d, 0) + SMOOTH)), 4) for d in DOMAINS] for r in top}
    return prior, weights, [size.get(d, 0) > 0 for d in DOMAINS]


def tables(keys: list[int], buckets: int = BUCKETS) -> list[tuple[int, int, dict[int, int]]]:
    """Lookup tables (shift, size, key by slot) that hold every key, each in one of them."""
    out, left, size = [], list(keys), buckets
    while left:
        best = max(range(0, 44, 4), key=lambda shift: len({(h >> shift) % size for h in left}))
        slots: dict[int, int] = {}
        for h in left:
            slots.setdefault((h >> best) % size, h)
        out.append((best, size, slots))
        left = [h for h in left if slots[(h >> best) % size] != h]
        size = max(64, size // 8)
    return out


def posteriors(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """docs with n_tokens and p_good, p_low, p_toxic."""
    prior, weights, _ = model
    out = featured(docs, text)
    found = tables(list(weights))
    parts = []
    for n, (shift, size, slots) in enumerate(found):
        keys = F.from_json(F.lit(json.dumps([slots.get(b, 0) for b in range(size)])), "array<long>")
        parts.append((f"_b{n}", _found(keys, shift, size)))
    out = out.withColumns(dict(parts))
    scores = []
    for k, d in enumerate(DOMAINS):
        score = F.lit(prior[k])
        for (name, _), (_, size, slots) in zip(parts, found):
            table = F.from_json(F.lit(json.dumps([weights[slots[b]][k] if b in slots else 0.0 for b in range(size)])), "array<double>")
            score = score + F.aggregate(name, F.lit(0.0), _adder(table))
        out = out.withColumn(f"_{d}", score)
        scores.append(f"_{d}")
    top = F.greatest(*scores)
    total = sum((F.exp(F.col(s) - top) for s in scores[1:]), F.exp(F.col(scores[0]) - top))
    return out.withColumns({f"p_{d}": F.exp(F.col(f"_{d}") - top) / total for d in DOMAINS}).drop("_h", *[name for name, _ in parts], *scores)


def _found(keys: Column, shift: int, size: int) -> Column:
    """Slots of the features that a table holds."""
    at = lambda h: F.pmod(F.shiftright(h, shift), F.lit(size)).cast("int")
    return F.transform(F.filter("_h", lambda h: F.get(keys, at(h)) == h), at)


def _adder(table: Column):
    return lambda total, i: total + F.get(table, i)


class Fit(NamedTuple):
    rates: list[float]  # by cell
    totals: list[float]  # expected tokens of each domain
    goals: list[float]
    objective: float
    moved: float  # the farthest that one more step would move a rate


def cell() -> Column:
    """Number of a document's cell: its posteriors to 1 / GRAIN, and whether it is clean."""
    good, low = (F.round(F.col(f"p_{d}") * GRAIN).cast("int") for d in DOMAINS[:2])
    clean = (F.greatest("p_good", "p_low") >= F.col("p_toxic")).cast("int")
    return (good * (GRAIN + 1) + low) * 2 + clean


def least_squares(sums: np.ndarray, goal: np.ndarray, mass: np.ndarray, low: np.ndarray, most: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE):
    """Rates of cells with those expected tokens (a row a cell), by accelerated projected gradient from 1."""
    share = sums / sums.sum(1, keepdims=True)
    scale = np.where(mass > 0, 1 / np.where(mass > 0, mass, 1), 0)

    def step(r):
        return np.clip(r - share @ ((r @ sums - goal) * scale), low, most)

    r = before = np.clip(np.ones(len(sums)), low, most)
    ahead, speed, moved = r, 1.0, np.inf
    for _ in range(rounds):
        before, r = r, step(ahead)
        if ((ahead - r) * sums.sum(1)) @ (r - before) > 0:  # uphill: start afresh
            speed = 1.0
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, speed = r + (speed - 1) / faster * (r - before), faster
        moved = float(np.abs(step(r) - r).max(initial=0))
        if moved <= tolerance:
            break
    return r, moved


def solve(rated: DataFrame, targets: dict[str, float], most: float | None = None, keep_clean: bool = False, known: list[bool] | None = None, rounds: int = ROUNDS) -> Fit:
    """Rates for targets, the share of all tokens that each domain should have.  known: which domains have labelled documents."""
    sums = [F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]
    rows = rated.groupBy(cell().alias("cell")).agg(*sums).where("good + low + toxic > 0").orderBy("cell").collect()  # (GRAIN + 1) ** 2 cells at most
    rates = [1.0] * (2 * (GRAIN + 1) ** 2)
    if not rows:
        return Fit(rates, [0.0] * 3, [0.0] * 3, 0.0, 0.0)
    at = np.array([r["cell"] for r in rows])
    own = np.array([[r[d] for d in DOMAINS] for r in rows])
    mass = own.sum(0)
    known = known if known is not None and any(known) else [True] * len(DOMAINS)
    whole = sum(targets[d] for d, k in zip(DOMAINS, known) if k) or 1.0
    part = sum(m for m, k in zip(mass, known) if k)
    goal = np.array([targets[d] / whole * part if k else m for d, m, k in zip(DOMAINS, mass, known)])
    low = np.where((at % 2 == 1) & keep_clean, 1.0, 0.0)
    r, moved = least_squares(own, goal, mass, low, math.inf if most is None else most, rounds)
    for k, x in zip(at.tolist(), r.tolist()):
        rates[k] = x
    got = r @ own
    return Fit(rates, got.tolist(), goal.tolist(), float((((got - goal) ** 2) / np.where(mass > 0, mass, 1)).sum() / mass.sum()), moved)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float | None = None, keep_clean: bool = False, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in keep, or all) with n_tokens, the posteriors, rate and copies.

    Posteriors are computed once and written to the shared folder with the kept
    columns.  copies is the rate rounded down or up by a hash of the id, so that
    expected totals hold.
    """
    model = fit(docs, labels)
    named = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in named]
    rows = cut(posteriors(docs.drop(*named), model, text).select(*keep, *named[:4]), "mixing-posteriors")
    rates = F.from_json(F.lit(json.dumps(solve(rows, targets, most, keep_clean, model[2]).rates)), "array<double>")
    rows = rows.withColumn("rate", F.get(rates, cell()))
    share = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + F.when(F.col("doc_id").isNotNull() & (share < F.col("rate") - F.floor("rate")), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long"))
