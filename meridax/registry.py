"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from meridax.plans import basics, learning, scenarios, shapes  # noqa: F401  they register their queries
from meridax.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
