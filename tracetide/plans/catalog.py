"""The registered queries over the provided tables and their DuckDB counterparts."""

from __future__ import annotations

from tracetide.plans import clock_queries, compound_queries, interval_queries, pair_queries, scoring_queries, signal_queries

MODULES = [interval_queries, signal_queries, pair_queries, clock_queries, scoring_queries, compound_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: query for module in MODULES for name, query in module.ORACLES.items()}
