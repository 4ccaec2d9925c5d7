"""Import every query module so the registry is complete."""

from __future__ import annotations

from scorewise.plans import registry
from scorewise.plans import analytics, classifiers, neighbors_q, relational  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
