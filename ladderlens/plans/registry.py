"""Names, Spark queries and oracle SQL of the library's own operators."""

from __future__ import annotations

from ladderlens.plans import bar_queries, book_queries, catalog_queries, event_queries, live_queries, source_queries

ALL = event_queries.QUERIES | book_queries.QUERIES | bar_queries.QUERIES | catalog_queries.QUERIES | live_queries.QUERIES | source_queries.QUERIES
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
FLAGSHIP = "b12_depth_liquidity"
