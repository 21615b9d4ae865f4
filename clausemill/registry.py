"""All queries outside the llm subpackage."""

from __future__ import annotations

from .plans import chunk_queries, job_queries, record_queries, result_queries, retrieval_queries
from .plans.job_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

MODULES = (chunk_queries, retrieval_queries, record_queries, result_queries, job_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
