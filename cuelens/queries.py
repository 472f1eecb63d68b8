"""The engine's queries by name, with the SQL each must agree with."""

from __future__ import annotations

from cuelens.plans import briefing, collecting, crosschecks, history, reader, screening  # noqa: F401
from cuelens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
