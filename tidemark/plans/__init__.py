"""Registered queries over the given tables, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("query_plans", "normalise_plans", "version_plans", "rollup_plans", "catalogue_plans", "stream_plans", "check_plans", "landing_plans")


def registered() -> tuple[dict, dict]:
    """(queries, SQL) of every area; each area's module has them as P and SQL."""
    found = [import_module(f"tidemark.plans.{a}") for a in AREAS]
    return {k: v for m in found for k, v in m.P.items()}, {k: v for m in found for k, v in m.SQL.items()}
