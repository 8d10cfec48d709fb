"""All registered queries and their SQL."""

from __future__ import annotations

from . import bids, citations, documents, geometry, jobs, locate, matches, operations, reports, reviews, sequences, splits, structure

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (bids, documents, citations, sequences, jobs, reviews, structure, splits, locate, matches, operations, reports, geometry):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
