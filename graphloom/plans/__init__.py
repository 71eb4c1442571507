"""The query catalogue: every registered query and its SQL counterpart."""

from graphloom.plans import graph_cases, integrity_cases, memory_cases, source_cases, vector_cases

_MODULES = (integrity_cases, vector_cases, graph_cases, memory_cases, source_cases)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
