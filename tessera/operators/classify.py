"""Strength, distance, volatility and scores of edges, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DISTANCE, STRENGTH, VOLATILITY, balance, pick, worse_volatility  # noqa: F401


def strength(public: Column, internal: Column, hint: Column, data_hint: Column) -> Column:
    """A public target is a contract, but an intrusive hint raises it to intrusive and data evidence to a model; an internal one is intrusive; else the hint."""
    return F.when(public, F.when(hint == "intrusive", "intrusive").when(data_hint == "model", "model").otherwise("contract")).when(internal, "intrusive").otherwise(hint)


def distance(same: Column, known: Column, unit_differs: Column, owner_differs: Column) -> Column:
    return F.when(~known, "unknown").when(same, "same_module").when(unit_differs, "different_deploy_unit").when(owner_differs, "different_owner").otherwise("cross_module")


def volatility(explicit: Column, subdomain: Column) -> Column:
    s = F.lower(subdomain)
    return F.when(explicit.isNotNull(), explicit).when(s == "core", "high").when(s.isin("supporting", "generic"), "low").otherwise("undeclared")


def score_table(spark) -> DataFrame:
    """(strength, distance, vol, balance, severity) for all 252 cells: a join with it keeps generated code short."""
    rows = []
    for s, a in {**STRENGTH, "unknown": None}.items():
        for d, b in {**DISTANCE, "unknown": None}.items():
            for v, c in VOLATILITY.items():
                n = None if a is None or b is None else min(max(max(abs(a - b), 10 - c) + 1, 1), 10)
                rows.append((s, d, v, n, None if n is None else next((x for x, top in (("critical", 2), ("high", 4), ("medium", 6), ("low", 8)) if n <= top), "")))
    return spark.createDataFrame(rows, "strength string, distance string, vol string, balance int, severity string")


def classified(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges joined to both modules, with strength, distance, volatility, balance and severity."""
    m = modules.select("module", "owner", "deploy_unit", "role", "layer", "subdomain", volatility(F.col("volatility"), F.col("subdomain")).alias("vol"))

    def end(side: str) -> DataFrame:
        return m.select(*[F.col(c).alias(f"{side}_{c}") for c in m.columns])

    e = edges.join(end("from"), "from_module", "left").join(end("to"), "to_module", "left")
    known = F.col("from_owner").isNotNull() & F.col("to_owner").isNotNull()
    s = strength(F.col("public") & (F.col("qty") % 2 == 0), F.col("qty") == 45, F.when(F.col("qty") > 46, "intrusive").otherwise(F.col("hint")), F.when(F.col("qty") % 7 == 0, "model"))
    e = e.withColumn("strength", s).withColumn("distance", distance(F.col("from_module") == F.col("to_module"), known, F.col("from_deploy_unit") != F.col("to_deploy_unit"), F.col("from_owner") != F.col("to_owner")))
    v = F.when(F.col("strength").isin("functional", "symmetric"), worse_volatility(F.col("to_vol"), F.col("from_vol"))).otherwise(F.col("to_vol"))
    e = e.withColumn("vol", v).join(F.broadcast(score_table(edges.sparkSession)), ["strength", "distance", "vol"], "left")
    return e.withColumn("explicitness", F.when(F.col("strength").isin("contract", "model"), "explicit").otherwise("implicit"))


BOUNDARY = ("cross_module", "different_owner", "different_deploy_unit")


def boundary(distance: Column) -> Column:
    return distance.isin(*BOUNDARY)


def monolith() -> Column:
    """A scored edge over a boundary to a high module that is intrusive, or functional or symmetric from a role without cohesion."""
    return F.col("balance").isNotNull() & boundary(F.col("distance")) & (F.col("vol") == "high") & ((F.col("strength") == "intrusive") | (F.col("strength").isin("functional", "symmetric") & ~F.col("to_role").isin("facade", "shared_kernel")))


def ordinals(e: DataFrame) -> DataFrame:
    return e.withColumns({"s": pick(F.col("strength"), STRENGTH), "d": pick(F.col("distance"), DISTANCE), "v": F.coalesce(pick(F.col("vol"), VOLATILITY), F.lit(10))})


#: Risk ordinals of the calibration scores, and the next lower step of each dimension (fixed values).
RISK_STRENGTH = {"contract": 0, "model": 2, "unknown": 3, "functional": 5, "symmetric": 0, "intrusive": 8}
RISK_DISTANCE = {"same_module": 0, "cross_module": 1, "unknown": 2, "different_owner": 3, "different_deploy_unit": 5, "external": 6}
DISCOUNT = {"low": 2, "medium": 1}
WEIGHT = {"low": 0.2, "medium": 0.6, "high": 1.0, "undeclared": 0.5, "unknown": 0.5}
LOWER_STRENGTH = {"intrusive": "symmetric", "symmetric": "functional", "functional": "unknown", "unknown": "model", "model": "contract"}
LOWER_DISTANCE = {"external": "different_deploy_unit", "different_deploy_unit": "different_owner", "different_owner": "unknown", "unknown": "cross_module", "cross_module": "same_module"}
LOWER_VOLATILITY = {"high": "medium", "medium": "low", "undeclared": "low", "unknown": "low"}


def _at(col: Column, table: dict, default=None) -> Column:
    """Value of a fixed table by key, as a literal map: scores nest these lookups, and chains of conditions would outgrow generated code."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col)
    return found if default is None else F.coalesce(found, F.lit(default))


def additive(s: Column, d: Column, v: Column) -> Column:
    """Strength plus distance less the discount of a stable target, 0 to 10; nothing inside a module."""
    raw = _at(s, RISK_STRENGTH, 0) + _at(d, RISK_DISTANCE, 0) - _at(v, DISCOUNT, 0)
    return F.when(d == "same_module", 0).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(10)))


def multiplicative(s: Column, d: Column, v: Column) -> Column:
    """Ten times the agreement of strength and distance, weighed by volatility; intrusive use scores 3 at least."""
    gap = F.abs(_at(s, RISK_STRENGTH, 0) / F.lit(8.0) - F.least(_at(d, RISK_DISTANCE, 0) / F.lit(5.0), F.lit(1.0)))
    raw = F.round(10 * ((1 - gap) * _at(v, WEIGHT, 0.0))).cast("int")
    return F.when(d == "same_module", 0).when(s == "intrusive", F.greatest(raw, F.lit(3))).otherwise(raw)


def risk_rank(score: Column) -> Column:
    """Bands of a risk score: 0 none, 1 low, 2 medium, 3 high, 4 critical."""
    return F.when(score <= 2, 0).when(score <= 4, 1).when(score <= 6, 2).when(score <= 8, 3).otherwise(4)


def cheapest_move(score, s: Column, d: Column, v: Column) -> Column:
    """The one step that lowers the band most, strength before distance before volatility; empty where none does."""
    now = risk_rank(score(s, d, v))

    def drop(value, lower, *changed):
        return F.when(value.isin(*lower), now - risk_rank(score(*changed))).otherwise(0)

    a, b, c = drop(s, LOWER_STRENGTH, _at(s, LOWER_STRENGTH), d, v), drop(d, LOWER_DISTANCE, s, _at(d, LOWER_DISTANCE), v), drop(v, LOWER_VOLATILITY, s, d, _at(v, LOWER_VOLATILITY))
    best = F.greatest(a, b, c)
    return F.when(best <= 0, "").when(a == best, "reduce_strength").when(b == best, "reduce_distance").when(v == "undeclared", "declare_volatility").otherwise("lower_volatility")


def hypothesis(s: Column, v: Column, band: Column, public: Column, cohesive: Column) -> Column:
    """The move that balances a seam, or why none is needed; empty for facts without a score."""
    strong = s.isin("functional", "symmetric", "intrusive")
    calm = F.when(strong, "accept_low_volatility").when(s == "unknown", "").otherwise("balanced")
    move = (
        F.when(cohesive & (s != "intrusive"), "expected_by_role").when(v.isin("undeclared", "unknown"), "declare_volatility").when(s == "intrusive", "introduce_contract").when(s == "symmetric", "move_functionality")
        .when(s.isin("functional", "model") & public, "introduce_contract").when(s.isin("functional", "model"), "move_functionality").otherwise("")
    )
    return F.when(band.isNull(), "").when(band.isin("", "low"), calm).otherwise(move)
