"""Named queries built from the operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("dump", "scalars", "scans", "stories", "counts", "search", "state", "gate", "tagging", "texts", "extra", "cards", "readers", "chain")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"pressloom.plans.{m}").Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"pressloom.plans.{m}").SQL.items()}
