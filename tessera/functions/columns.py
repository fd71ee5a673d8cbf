"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinals (fixed values).
STRENGTH = {"contract": 1, "model": 3, "functional": 8, "symmetric": 9, "intrusive": 10}
DISTANCE = {"same_module": 2, "cross_module": 9, "different_owner": 9, "different_deploy_unit": 9, "external": 10}
VOLATILITY = {"frozen": 1, "low": 3, "medium": 6, "high": 10, "undeclared": 10, "unknown": 10}
STRENGTH_RANK = {"unknown": 0, "contract": 1, "model": 2, "functional": 3, "symmetric": 4, "intrusive": 5}
DISTANCE_RANK = {"unknown": 0, "same_module": 1, "cross_module": 2, "different_owner": 3, "different_deploy_unit": 4, "external": 5}
VOLATILITY_RANK = {"frozen": 1, "low": 2, "medium": 3, "undeclared": 4, "unknown": 4, "high": 5}


def pick(col: Column, table: dict, default=None) -> Column:
    """Value of a short fixed table by key."""
    out = None
    for k, v in table.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default)


def directory(path: Column) -> Column:
    """Parent directory; '.' where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def balance(strength: Column, distance: Column, volatility: Column) -> Column:
    """Book score 1..10; null where strength or distance is unknown."""
    s, d = pick(strength, STRENGTH), pick(distance, DISTANCE)
    v = F.coalesce(pick(volatility, VOLATILITY), F.lit(10))
    raw = F.greatest(F.abs(s - d), 10 - v) + 1
    return F.when(s.isNotNull() & d.isNotNull(), F.least(F.greatest(raw, F.lit(1)), F.lit(10)))


def severity(score: Column) -> Column:
    return F.when(score <= 2, "critical").when(score <= 4, "high").when(score <= 6, "medium").when(score <= 8, "low").when(score.isNotNull(), "")


def worse_volatility(a: Column, b: Column) -> Column:
    """The worse of two; a where they are as bad."""
    return F.when(pick(b, VOLATILITY_RANK, 4) > pick(a, VOLATILITY_RANK, 4), b).otherwise(a)


def joined(col: Column) -> Column:
    return F.array_join(F.array_sort(col), ",")
