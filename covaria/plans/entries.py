"""Collects all queries."""

from __future__ import annotations

from covaria.plans import closed, detection, estimation, layout, limits, matrices, montecarlo, streams  # noqa: F401
from covaria.plans.registry import ENTRIES


def queries():
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in ENTRIES.items() if e.sql is not None}
