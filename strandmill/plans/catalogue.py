"""All queries of the core library."""

from __future__ import annotations

from strandmill.plans import curve_queries, heavy_queries, mate_queries, model_queries, run_queries, sequence_queries

FLAGSHIP = "best_mate_sketch"
_MODULES = (heavy_queries, sequence_queries, mate_queries, curve_queries, model_queries, run_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
