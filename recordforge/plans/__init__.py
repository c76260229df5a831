"""Queries over the given tables, one module per family."""

from recordforge.plans.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from recordforge.plans import checks, deep_checks, derived, files, ledgers, plain_rules, reporting, streams, unit_sets  # noqa: F401

    return QUERIES, ORACLES
