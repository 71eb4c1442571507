"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from graphloom.llm import q_docs, q_leaks, q_mixing, q_scores, q_secrets, q_spans, q_vectors

_MODULES = (q_docs, q_scores, q_vectors, q_leaks, q_mixing, q_secrets, q_spans)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
