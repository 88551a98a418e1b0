"""All relational queries with their DuckDB counterparts."""

from __future__ import annotations

from . import retrieval, services, texts, vectors

MODULES = (vectors, texts, retrieval, services)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
