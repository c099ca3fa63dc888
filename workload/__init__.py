"""Queries over the given tables, each with equal SQL where SQL can express it."""

from . import changes, exchange, flow, history, mined, summaries

_MODULES = (changes, mined, exchange, flow, history, summaries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: statement for module in _MODULES for name, statement in module.SQL.items()}
