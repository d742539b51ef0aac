"""All registered queries of the library itself."""

from __future__ import annotations

from docquarry.plans import agent, answers, blocks, graph, ingest, metrics, reports, retrieval, scoring, store, structures

QUERIES, ORACLE_SQL = {}, {}
for module in (retrieval, graph, agent, blocks, scoring, answers, metrics, reports, store, ingest, structures):
    QUERIES |= module.R.queries
    ORACLE_SQL |= module.R.sql
