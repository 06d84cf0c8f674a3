"""Every registered query, and the SQL that gives the same result."""

from __future__ import annotations

from maskwright.plans import audit_queries, model_queries, request_queries, stream_queries, text_queries

_TOPICS = [text_queries, request_queries, audit_queries, model_queries, stream_queries]

QUERIES = {name: query for topic in _TOPICS for name, query in topic.QUERIES.items()}
ORACLES = {name: sql for topic in _TOPICS for name, sql in topic.ORACLES.items()}
