"""All queries of the library, with their SQL."""

from __future__ import annotations

from .plans import analytics, curation, dialect, evaluation, funds, holdings, operators, signals, tables, text  # noqa: F401

QUERIES: dict = {name: dialect.run(name) for name in dialect.PLANS} | operators.QUERIES
ORACLE_SQL: dict = {name: dialect.oracle(name) for name in dialect.PLANS} | operators.ORACLE_SQL
