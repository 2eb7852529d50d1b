"""Queries over the driver's tables, one or more an operator, each with a DuckDB twin where SQL can say it."""

from lattica.queries import lists, scalars, tables
from lattica.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "lists", "scalars", "tables"]
