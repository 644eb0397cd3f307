"""Rows that fail to parse: delimited lines loaded as nullable text, then ruled on.

Every line is taken apart into nullable text columns with built-in string and
array functions. Format and value rules then fill an error array in the order of
their precedence; an empty array means a valid row. There is no shuffle and the rules
run where the scan runs, each once a line; lines without a quote are taken apart by a
split, others by one expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = r'("(?:[^"]++|"")*+"|[^",]*+)'


@dataclass(frozen=True)
class Rule:
    """An SQL condition over the field columns that holds for a good row, and the reason given otherwise."""

    condition: str
    reason: str = "invalid_value"


@dataclass(frozen=True)
class LineFormat:
    """Field names in order, the rules over them, and the types of the loaded columns."""

    fields: tuple[str, ...]
    rules: tuple[Rule, ...]
    types: tuple[str, ...]


#: Name, lane, bases and qualities of one read per line.
READ_LINE = LineFormat(
    fields=("read_name", "lane", "seq1", "qual1"),
    rules=(
        Rule(r"read_name rlike r'\A[!-~]+\z'"),
        Rule(r"lane rlike r'\A[1-8]\z'"),
        Rule(r"seq1 rlike r'\A[ACGTNacgtn]+\z'"),
        Rule(r"qual1 = '*' or (length(qual1) = length(seq1) and qual1 rlike r'\A[!-~]+\z')"),
    ),
    types=("string", "int", "string", "string"),
)


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is evaluated once a row: filters and projections that follow read its value instead of repeating it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_lines(df: DataFrame, line: str, keep: Sequence[str] = (), fmt: LineFormat = READ_LINE) -> DataFrame:
    """``keep`` columns, the text fields of ``fmt`` and ``errors`` (array of reasons) of every line.

    One carriage return at the end isn't part of the line. Reasons in order:
    ``column_count`` for a null or empty line, ``quoting`` for quotes that don't
    enclose whole fields, ``column_count`` for another number of fields, then the
    reason of each rule that doesn't hold, and ``invalid_value`` for each field that
    its type can't take; a rule that yields null doesn't hold.
    Fields are null where the line can't be taken apart. Other columns of ``df``
    are left out, so their names can't clash; a kept column must not bear the name
    of a field or ``errors``. Repeated lines are ruled on one by one; an empty
    table yields an empty table.
    """
    clash = set(keep) & {*fmt.fields, "errors"}
    if clash:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    raw = df.select(*[F.col(c) for c in keep], F.col(line).alias("__raw"))
    base = _once(raw, F.when(F.col("__raw").endswith("\r"), F.expr("left(__raw, length(__raw) - 1)")).otherwise(F.col("__raw")), "__line")
    quoted = F.contains("__line", F.lit('"'))
    part = F.split("__line", '"', -1)
    # Even parts lie outside quotes: an empty one between two quotes is a doubled
    # quote, any other must touch the quotes beside it with commas.
    outside = F.filter(part, lambda _, i: i % 2 == 0)
    sound = (F.size(part) % 2 == 1) & F.forall(
        F.transform(
            part,
            lambda x, i: (i % 2 == 1)
            | (x == "")
            | (((i == 0) | x.startswith(",")) & ((i == F.size(part) - 1) | x.endswith(","))),
        ),
        lambda ok: ok,
    )
    commas = F.aggregate(F.when(quoted, outside).otherwise(F.array("__line")), F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    shape = (
        F.when(F.coalesce(F.col("__line"), F.lit("")) == "", "column_count")
        .when(quoted & ~sound, "quoting")
        .when(commas != len(fmt.fields) - 1, "column_count")
    )
    shaped = _once(base, shape, "__shape")
    whole = r"(?s)\A" + ",".join([FIELD] * len(fmt.fields)) + r"\z"
    taken = F.array(*[_unquoted(F.regexp_extract("__line", whole, i + 1)) for i in range(len(fmt.fields))])
    parted = _once(shaped, F.when(F.col("__shape").isNull(), F.when(quoted, taken).otherwise(F.split("__line", ",", -1))), "__field")
    loaded = parted.select(*[F.col(c) for c in keep], "__shape", *[F.get("__field", F.lit(i)).alias(c) for i, c in enumerate(fmt.fields)])
    casts = [Rule(f"try_cast(`{c}` as {t}) is not null") for c, t in zip(fmt.fields, fmt.types) if t != "string"]
    broken = [F.when(~F.coalesce(F.expr(r.condition), F.lit(False)), F.lit(r.reason)) for r in (*fmt.rules, *casts)]
    errors = F.when(F.col("__shape").isNotNull(), F.array("__shape")).otherwise(F.array_compact(F.array(*broken)))
    return _once(loaded, errors, "errors").select(*keep, *fmt.fields, "errors")


def valid_rows(parsed: DataFrame, keep: Sequence[str] = (), fmt: LineFormat = READ_LINE) -> DataFrame:
    """Rows without an error, their fields cast to the types of the format."""
    typed = [F.col(c).cast(t).alias(c) for c, t in zip(fmt.fields, fmt.types)]
    return parsed.filter(F.size("errors") == 0).select(*keep, *typed)


def rejected_rows(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with an error and the first reason that holds."""
    return parsed.filter(F.size("errors") > 0).select(*keep, F.get("errors", F.lit(0)).alias("reason"))
