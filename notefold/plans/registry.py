"""All queries of the core with their SQL, by name."""

from __future__ import annotations

from notefold.operators import nested, references
from notefold.plans import candidate_queries, excerpt_queries, generation_queries, inspection_queries, quality_queries, rebuild_queries, scoring_queries, selection_queries, short_clip_queries, streaming_queries

MODULES = [references, nested, excerpt_queries, short_clip_queries, scoring_queries, selection_queries, inspection_queries, quality_queries, candidate_queries, generation_queries, rebuild_queries, streaming_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
