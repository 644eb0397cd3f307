"""Splitting oversized items at natural boundaries by one bounded regular expression.

The alternatives of the expression are ordered by boundary strength and each
consumes as much as the limit lets it: the rest of the item; up to a place inside
or at an edge of a long unknown stretch; up to a place inside a short unknown
stretch; else single letters up to the limit. What the expression consumes are the
cores of the pieces; every piece but the first is preceded by the last ``overlap``
letters before its core. Everything is a projection, so only the rows themselves
are read and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Pieces that are gathered before they are put aside.
GROUP = 256


def boundary_pattern(step: int, strong: int = 10, weak: int = 3, letter: str = "[Nn]") -> str:
    """Expression that consumes the next core of at most ``step`` letters.

    Group 1 is a core that ends at a strong boundary or at the end of the item,
    group 2 one that ends at a weak boundary, group 3 the fallback by letters.
    """
    near = lambda n: f"(?:(?<={letter}{{{n}}})|(?={letter}{{{n}}}))"
    return rf"(?s)(.{{1,{step}}}\z|.{{1,{step}}}{near(strong)})|(.{{1,{step}}}{near(weak)})|(.{{1,{step}}})"


def cores_of(text: Column, pattern: str) -> Column:
    """The consecutive cores of a text; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def is_forced(text: Column, pattern: str) -> Column:
    """Whether a core of the text ends elsewhere than at a strong boundary."""
    weaker = [F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: x != "") for g in (2, 3)]
    return weaker[0] | weaker[1]


def pieces_of(cores: Column, overlap: int) -> Column:
    """Array of (start, end, piece) from the cores; start and end are 0-based letters of the item, end exclusive."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,piece:string>>")
    none = F.array().cast("array<array<struct<start:bigint,end:bigint,piece:string>>>")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"), empty.alias("last"), none.alias("done"))

    def add(s, core):
        end = s["at"] + F.length(core)
        both = F.concat(s["tail"], core)
        row = F.struct((s["at"] - F.length(s["tail"])).alias("start"), end.alias("end"), both.alias("piece"))
        # An array is copied when it grows; full ones are put aside, so the pieces of a long item aren't copied at each step.
        full = F.size(s["last"]) >= GROUP
        last = F.when(full, F.array(row)).otherwise(F.array_append(s["last"], row))
        done = F.when(full, F.array_append(s["done"], s["last"])).otherwise(s["done"])
        return F.struct(end.alias("at"), F.right(both, F.lit(overlap)).alias("tail"), last.alias("last"), done.alias("done"))

    return F.aggregate(cores, state, add, lambda s: F.flatten(F.array_append(s["done"], s["last"])))


def split_oversized(
    df: DataFrame, text: str, limit: int, overlap: int, keep: Sequence[str] = (), strong: int = 10, weak: int = 3
) -> DataFrame:
    """One row per item: ``keep`` columns, ``cut`` and ``pieces`` (array of start, end, piece in order).

    ``cut`` is null for an item within the limit (one piece, the item itself),
    ``natural`` if every cut lies at a strong boundary, else ``forced``. No piece is
    longer than ``limit``; neighbours share ``overlap`` letters, fewer only where the
    first core is shorter than that. A null text gives a null array, an empty one an
    empty array. Repeated rows are split one by one; other columns are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    pattern = boundary_pattern(limit - overlap, strong, weak)
    item = F.col(text)
    long = F.length(item) > limit
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.length(item).cast("bigint").alias("end"), item.alias("piece")))
    return df.select(
        *[F.col(c) for c in keep],
        F.when(long, F.when(is_forced(item, pattern), "forced").otherwise("natural")).alias("cut"),
        F.when(long, pieces_of(cores_of(item, pattern), overlap))
        .when(F.length(item) > 0, whole)
        .when(item.isNotNull(), F.array().cast("array<struct<start:bigint,end:bigint,piece:string>>"))
        .alias("pieces"),
    )
