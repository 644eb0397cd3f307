"""The operators as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandframe.operators.syncmers import CODES, syncmers_of


@udtf(returnType="key44 bigint, pos int")
class Syncmers:
    """Table function ``syncmers(seq)``; none for a null or short sequence."""

    def eval(self, seq: str) -> Iterator[tuple[int, int]]:
        if seq:
            at, hashes = syncmers_of(CODES[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)])
            for p, h in zip(at.tolist(), hashes.tolist()):
                yield h >> 20, p


def register_functions(spark: SparkSession) -> None:
    """``syncmers`` as a table function, ``reverse_complement`` and ``cigar_span`` as SQL functions."""
    spark.udtf.register("syncmers", Syncmers)
    spark.sql(
        "create or replace temporary function reverse_complement(s string) returns string "
        "return regexp_replace(translate(reverse(s), 'ACGTacgt', 'TGCAtgca'), '[^ACGTacgt]', 'N')"
    )
    spark.sql(
        "create or replace temporary function cigar_span(c string) returns int return "
        "aggregate(regexp_extract_all(c, '([0-9]+)[MDN=X]', 1), 0, (n, x) -> n + cast(x as int))"
    )
