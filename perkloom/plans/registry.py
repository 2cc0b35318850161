"""All registered queries and their SQL twins."""

from __future__ import annotations

from perkloom.plans import (
    benefit_queries,
    ingest_queries,
    place_queries,
    storage_queries,
    stream_queries,
    text_queries,
)

_MODULES = [benefit_queries, place_queries, ingest_queries, text_queries, storage_queries, stream_queries]

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
