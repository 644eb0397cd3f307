"""Registered queries of problem 5."""

from __future__ import annotations

from strandframe.operators.malformed import parse_lines, rejected_rows, valid_rows
from strandframe.runtime import table


def _parsed(spark, directory):
    return parse_lines(table(spark, directory, "raw_reads"), "raw_line", keep=["raw_id"])


QUERIES = {
    "p5_found": lambda spark, d: rejected_rows(_parsed(spark, d), keep=["raw_id"]),
    "p5_loaded": lambda spark, d: valid_rows(_parsed(spark, d), keep=["raw_id"]),
}

_SHAPE = r"""
with l as (select raw_id, regexp_replace(raw_line, '\r\z', '') line from raw_reads),
q as (select *, regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') quoted,
      regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*)){3}', 's') four from l),
f as (select *, case when quoted and four and line <> '' then
      regexp_extract_all(line, '(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1) end parts from q),
u as (select *, [case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end for x in parts] v from f),
r as (select raw_id, v, case when coalesce(line, '') = '' then 'column_count' when not quoted then 'quoting'
      when not four then 'column_count'
      when not (regexp_full_match(v[1], '[!-~]+') and regexp_full_match(v[2], '[1-8]')
                and regexp_full_match(v[3], '[ACGTNacgtn]+')
                and (v[4] = '*' or (length(v[4]) = length(v[3]) and regexp_full_match(v[4], '[!-~]+')))) then 'invalid_value' end reason from u)
"""

SQL = {
    "p5_found": _SHAPE + "select raw_id, reason from r where reason is not null",
    "p5_loaded": _SHAPE
    + "select raw_id, v[1] read_name, cast(v[2] as int) lane, v[3] seq1, v[4] qual1 from r where reason is null",
}
