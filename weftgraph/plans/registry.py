"""Registered graph queries and their SQL twins."""

from __future__ import annotations

from weftgraph.plans import graph_queries, more_queries, version_queries

FLAGSHIP = "coverage_transitive"
QUERIES = {**graph_queries.QUERIES, **version_queries.QUERIES, **more_queries.QUERIES}
ORACLES = {**graph_queries.ORACLES, **version_queries.ORACLES, **more_queries.ORACLES}
