"""Registered queries and oracles of the engine's own operators."""

from . import conversation_queries, document_queries, store_queries, text_queries, vector_queries

_MODULES = (document_queries, text_queries, vector_queries, conversation_queries, store_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
