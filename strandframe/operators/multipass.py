"""References in several passes: a mate mapped in one pass is left out of the later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.runtime import cut


def reference_passes(references: DataFrame, letters: int) -> DataFrame:
    """``ref_id`` and ``ref_pass``: consecutive references filled up to about so many letters.

    The running length is taken over groups of 4,096 ids, then over the groups.
    """
    sizes = references.select("ref_id", F.coalesce(F.length("seq"), F.lit(0)).cast("bigint").alias("n"), F.floor(F.col("ref_id") / 4096).alias("g"))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("gn"))
    before = Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("g").orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "g")
    return rows.select("ref_id", F.floor((F.col("base") + F.col("inner")) / letters).cast("int").alias("ref_pass"))


def unmapped(mates: DataFrame, alignments: DataFrame) -> DataFrame:
    """Mates (``read_id, mate, ...``) without an alignment."""
    return mates.join(alignments.select("read_id", "mate").distinct(), ["read_id", "mate"], "left_anti")


def first_pass_wins(alignments: DataFrame) -> DataFrame:
    """Of alignments with ``ref_pass``, those of the first pass in which the mate was mapped."""
    first = Window.partitionBy("read_id", "mate")
    return alignments.withColumn("__p", F.min("ref_pass").over(first)).filter(F.col("ref_pass") == F.col("__p")).drop("__p")


def map_in_passes(reads: DataFrame, references: DataFrame, letters: int, align) -> DataFrame:
    """Alignments with ``ref_pass``; ``align(reads, references)`` is run for one pass after the other.

    The number of passes is the total length over ``letters``, a setting like the size of
    an executor's memory; mates that a pass has mapped are not sent to the next.
    """
    placed = references.join(reference_passes(references, letters), "ref_id")
    passes = [r[0] for r in placed.select("ref_pass").distinct().orderBy("ref_pass").collect()]
    done: DataFrame | None = None
    for number in passes:
        left = reads
        if done is not None:
            flags = done.select("read_id", "mate").distinct().groupBy("read_id").agg(F.bit_or(F.col("mate")).alias("__mapped"))
            left = reads.join(flags, "read_id", "left")
            for m in (1, 2):
                left = left.withColumn(f"seq{m}", F.when(F.coalesce("__mapped", F.lit(0)).bitwiseAND(m) == 0, F.col(f"seq{m}")))
            left = left.drop("__mapped").filter("seq1 is not null or seq2 is not null")
        found = cut(align(left, placed.filter(F.col("ref_pass") == number)).withColumn("ref_pass", F.lit(number)))
        done = found if done is None else done.unionByName(found)
    return done
