"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from corpusloom.plans.registry import ORACLES, QUERIES

for _part in ("q_profile", "q_text", "q_records", "q_aggregates", "q_features", "q_stats", "q_checks", "q_sources", "q_ml"):
    import_module(f"corpusloom.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
