"""Registered queries (``catalog.queries()``) and their DuckDB oracles."""
