"""Read pairs cut from references, with planted origin and substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequences import reverse_complement


def simulated_pairs(references: DataFrame, read: int = 150, fragment: int = 300, spacing: int = 200, substitution: int = 97) -> DataFrame:
    """Pairs about every ``spacing`` bases of each reference of at least ``fragment`` bases.

    Start, strand and the place of one substitution in each mate come from a hash of
    reference and number, so the same references always give the same pairs. The name
    carries the reference, the 1-based places of both mates and their strands.
    """
    refs = references.filter(F.length("seq") >= fragment).select("ref_id", "ref_name", F.upper("seq").alias("s"))
    room = F.length("s") - fragment
    rows = refs.select("*", F.explode(F.sequence(F.lit(0), F.floor(room / spacing).cast("int"))).alias("k"))
    h = F.xxhash64("ref_id", "k")
    start = F.least(room, F.col("k") * spacing + F.pmod(h, F.lit(spacing)).cast("int"))
    piece = rows.select(
        "ref_id", "ref_name", "k", start.alias("at"), (F.pmod(F.shiftrightunsigned(h, 20), F.lit(2)) == 1).alias("rev"), F.substring("s", start + 1, F.lit(fragment)).alias("f"),
        F.pmod(F.shiftrightunsigned(h, 30), F.lit(substitution)).cast("int").alias("e"),
    )
    a = F.substring("f", F.lit(1), F.lit(read))
    b = F.substring("f", F.lit(fragment - read + 1), F.lit(read))
    wrong = lambda s, at: F.concat(F.left(s, at), F.translate(F.substring(s, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(s, at + 2, F.length(s)))
    left, right = wrong(a, F.col("e")), reverse_complement(wrong(b, F.lit(read - 1) - F.col("e")))
    first, second = F.col("at") + 1, F.col("at") + fragment - read + 1
    rev = F.col("rev")
    name = F.concat_ws("_", "ref_name", F.when(rev, second).otherwise(first), F.when(rev, first).otherwise(second), F.when(rev, 1).otherwise(0), F.when(rev, 0).otherwise(1), F.lit("0:0:0"), "k")
    quality = F.repeat(F.lit("I"), read)
    return piece.select(
        (F.col("ref_id") * (1 << 24) + F.col("k")).alias("read_id"), name.alias("name"), F.when(rev, right).otherwise(left).alias("seq1"), quality.alias("qual1"),
        F.when(rev, left).otherwise(right).alias("seq2"), quality.alias("qual2"),
    )
