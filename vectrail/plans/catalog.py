"""Named queries over the standard tables, and their SQL."""

from __future__ import annotations

from vectrail.plans import classify_queries, graph_queries, latent_queries, metadata_queries, search_queries

_PARTS = (search_queries, metadata_queries, graph_queries, latent_queries, classify_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
