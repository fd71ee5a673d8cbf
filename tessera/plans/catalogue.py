"""All registered queries over the driver's tables."""

from __future__ import annotations

from . import changes, configs, coupling, evaluation, graphs, metrics, policies, policyfiles, questions, reports, rules, states, streams, trees, verdicts  # noqa: F401  they fill the registry
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
