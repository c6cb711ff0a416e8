"""The library's queries by name, each with the SQL that checks it."""

from __future__ import annotations

from harvestry.plans import decisions, features, ingest, names, nearby, reports, sources, warnings
from harvestry.plans.registry import ORACLE_SQL, QUERIES

MODULES = (ingest, features, names, decisions, reports, sources, warnings, nearby)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
