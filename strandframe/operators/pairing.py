"""Pair resolution: the mates' alignments that fit together best.

A read has at most two alignments of each mate, so they are gathered once by read
(one shuffle) and joined by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.functions.sequences import cigar_span

_FIELDS = ["rank", "ref_id", "pos", "is_rev", "mapq", "cigar", "nm", "as_score"]


def by_read(alignments: DataFrame) -> DataFrame:
    """``read_id`` and the alignments of each mate, ``a1`` and ``a2``, by rank."""
    one = F.struct(*_FIELDS, (F.col("pos") + cigar_span(F.col("cigar"))).alias("end"))
    sides = [F.array_sort(F.collect_list(F.when(F.col("mate") == m, one))).alias(f"a{m}") for m in (1, 2)]
    return alignments.groupBy("read_id").agg(*sides)


def _distance(x: Column, y: Column) -> Column:
    return F.greatest(x["end"], y["end"]) - F.least(x["pos"], y["pos"])


def fitting_pairs(cfg: MapperConfig = CONFIG) -> Column:
    """Array of (score, i, j) of the fitting pairs of ``a1`` and ``a2``, best first: same reference, opposite strands, near each other."""

    def pair(x, y):
        fits = (x["ref_id"] == y["ref_id"]) & (x["is_rev"] != y["is_rev"]) & (_distance(x, y) < cfg.pair_distance)
        return F.when(fits, F.struct((-(x["as_score"] + y["as_score"])).alias("score"), x["rank"].alias("i"), y["rank"].alias("j")))

    every = F.flatten(F.transform("a1", lambda x: F.transform("a2", lambda y: pair(x, y))))
    return F.transform(F.array_sort(F.array_compact(every)), lambda p: F.struct((-p["score"]).alias("score"), p["i"].alias("i"), p["j"].alias("j")))


def pair_candidates(alignments: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """One row per fitting pair: ``read_id, i, j, score``."""
    return by_read(alignments).select("read_id", F.explode(fitting_pairs(cfg)).alias("p")).select("read_id", "p.i", "p.j", "p.score")


def resolve_pairs(alignments: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """``read_id``, the chosen ``r1`` and ``r2`` (null if unmapped), ``proper`` and ``tlen`` of the first mate.

    The best fitting pair by score (then by rank) is taken; its confidence is 60 if it
    is the only one or leads by more than 30, else twice its lead. Without a fitting
    pair each mate keeps its first alignment. ``proper`` holds for opposite strands
    within the pair distance, ``tlen`` is signed by the order of the mates.
    """
    rows = by_read(alignments).withColumn("pairs", fitting_pairs(cfg))
    best = F.get("pairs", F.lit(0))
    lead = best["score"] - F.get("pairs", F.lit(1))["score"]
    mapq = F.when(lead.isNull() | (lead > 30), 60).otherwise(2 * lead).cast("int")

    def chosen(side: str, at: str) -> Column:
        first = F.get(side, F.lit(0))
        taken = F.filter(side, lambda x: x["rank"] == best[at])
        return F.when(best.isNotNull(), F.get(taken, F.lit(0)).withField("mapq", mapq)).otherwise(first)

    picked = rows.select("read_id", chosen("a1", "i").alias("r1"), chosen("a2", "j").alias("r2"))
    r1, r2 = F.col("r1"), F.col("r2")
    same = F.coalesce(r1["ref_id"] == r2["ref_id"], F.lit(False))
    size = _distance(r1, r2)
    proper = same & (r1["is_rev"] != r2["is_rev"]) & (size < cfg.pair_distance)
    tlen = F.when(same, F.when(r1["pos"] <= r2["pos"], size).otherwise(-size)).otherwise(0)
    return picked.select("read_id", "r1", "r2", F.coalesce(proper, F.lit(False)).alias("proper"), tlen.cast("int").alias("tlen"))


def first_alignments(alignments: DataFrame) -> DataFrame:
    """Variant without pairing: each mate's first alignment, no proper pairs, template length 0."""
    rows = by_read(alignments)
    return rows.select(
        "read_id", F.get("a1", F.lit(0)).alias("r1"), F.get("a2", F.lit(0)).alias("r2"), F.lit(False).alias("proper"), F.lit(0).alias("tlen")
    )
