"""All named queries; importing the plan modules registers them."""

from __future__ import annotations

from tessera.plans import curation, harness, journal, planning, relational, retrieval, rules, store, surfaces, workspace  # noqa: F401
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
