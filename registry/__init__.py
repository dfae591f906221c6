"""Registered queries over the given tables, each beside the SQL that states its expected result."""

from registry.base import QUERIES, SQL

from registry import stats, risk, segments, coverage, topics, judge, narratives, infer, sources  # noqa: F401, E402  (importing registers)

__all__ = ["QUERIES", "SQL"]
