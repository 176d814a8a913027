"""Queries over the given tables, and the DuckDB SQL that states the same."""

from tessera.plans import intake, joined, ledger, portfolio, returns, statistics, tables  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
