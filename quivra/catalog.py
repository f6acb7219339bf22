"""The registered queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from quivra.plans import kv_queries, vector_queries

QUERIES = {**vector_queries.QUERIES, **kv_queries.QUERIES}
ORACLES = {**vector_queries.ORACLES, **kv_queries.ORACLES}
