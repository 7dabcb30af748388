"""Queries by name and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules of this package, each with QUERIES and ORACLE_SQL.
MODULES = ("reference", "assessed", "records", "general")


def all_queries() -> dict[str, Callable]:
    """The queries of all modules by name."""
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    """The SQL of all modules by query name."""
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
