"""All queries of the core with their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from matchloom.plans import job_queries, relational_queries, state_queries, stream_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (text_queries, state_queries, job_queries, vector_queries, stream_queries, relational_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
FLAGSHIP = "hybrid_search"
