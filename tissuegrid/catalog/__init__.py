"""Named queries over the TPC-H-like tables, each with the SQL that gives the same rows."""

from . import cohort_queries, grid_queries, model_queries, patch_queries, scoring_queries, source_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
