"""All registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from weft.plans import analysis_queries, io_queries, join_queries, table_queries, text_queries

_PARTS = [table_queries, join_queries, analysis_queries, text_queries, io_queries]
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
flagship = table_queries.flagship
