"""All queries of the core library."""

from __future__ import annotations

from termweave.plans import enrichment, hierarchies, sql

QUERIES = {**hierarchies.QUERIES, **enrichment.QUERIES}
ORACLE = {**hierarchies.ORACLE, **sql.ORACLE}
FLAGSHIP = "enrich_multi"
