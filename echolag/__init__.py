"""Temporal dependencies between changes, mined with Spark DataFrames."""

from . import functions, operators, plans, schemas, session, sources

__all__ = ["functions", "operators", "plans", "schemas", "session", "sources"]
