"""All queries by key, with their oracle SQL. Importing a module of ``plans`` registers its queries."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLES, QUERIES

MODULES = ("scalars", "logs", "clusters", "search", "documents", "pipes", "structure", "more", "detect", "compressors", "captured", "conversations", "tools", "talk", "summaries")
for _name in MODULES:
    importlib.import_module(f".plans.{_name}", __package__)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
