"""All registered queries of the subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from strandframe.llm import queries

QUERIES = queries.QUERIES
SQL = queries.SQL
