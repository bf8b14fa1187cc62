"""The catalogue of named queries and their SQL."""

from corpuslens.plans import corpus_queries, evidence_queries, judge_queries, report_queries, retrieval_queries, star_queries, stats_queries  # noqa: F401
from corpuslens.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
