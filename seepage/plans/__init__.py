"""Registered queries over the test tables, each with its check SQL."""

from seepage.plans import dump_queries, join_queries, page_queries, source_queries, text_queries  # noqa: F401
from seepage.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
