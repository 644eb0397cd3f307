"""All registered queries of the core, and their SQL twins."""

from __future__ import annotations

from strandframe.plans import malformed_queries, mapper_queries, sam_queries

_MODULES = (mapper_queries, sam_queries, malformed_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark, directory):
    """The query that stands for the whole engine."""
    return QUERIES["map_paired"](spark, directory)
