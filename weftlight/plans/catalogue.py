"""Registered queries of the evidence operators, with the SQL that gives the same rows."""

from weftlight.plans import evidence_queries, graph_queries, note_queries, planning_queries, retrieval_queries, storage_queries, stream_queries, verification_queries  # noqa: F401
from weftlight.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_rank_fusion"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
