"""Registered queries: adapters from the given tables, operators, and independent SQL."""

from .core import QUERIES, oracle_sql, queries  # noqa: F401
