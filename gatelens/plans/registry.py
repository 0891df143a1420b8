"""All queries and their SQL, by key."""

from __future__ import annotations

import importlib

_SECTIONS = ("requests", "security", "cache", "routing", "cost", "stats", "streams", "request_path")


def _sections():
    # The security section completes shared table expressions, so it loads first.
    importlib.import_module("gatelens.plans.security")
    return [importlib.import_module(f"gatelens.plans.{name}") for name in _SECTIONS]


def queries() -> dict:
    return {key: query for section in _sections() for key, query in section.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for section in _sections() for key, sql in section.SQL.items()}
