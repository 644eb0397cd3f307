"""Seed lookup as an equi-join with bounded fan-out, and votes over diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.operators.index import ranked
from strandframe.operators.syncmers import explode_syncmers
from strandframe.runtime import cut

READ = ["read_id", "mate"]
#: Index rows that are broadcast at most, some 40 bytes each; a larger index is joined by a shuffle of both sides.
BROADCAST_SEEDS = 2_000_000


def mates(reads: DataFrame) -> DataFrame:
    """``read_id``, ``mate`` (1, 2) and ``seq`` of every non-empty sequence of ``seq1`` and ``seq2``."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"seq{m}").alias("seq")) for m in (1, 2)]))
    return reads.select("read_id", each.alias("m")).select("read_id", "m.mate", "m.seq").filter(F.length("seq") > 0)


def probes(reads: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """Syncmers of both strands of all mates: ``read_id, mate, is_rev, key44, qpos``."""
    return explode_syncmers(mates(reads), READ, "seq", both_strands=True, cfg=cfg).withColumnRenamed("pos", "qpos")


def seed_hits(probed: DataFrame, index: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """Hits ``read_id, mate, is_rev, qpos, ref_id, pos, diag, full``.

    A probe takes at most ``most_per_probe`` seeds, a read at most ``most_per_read`` in
    the order of (strand, qpos, ref_id, pos). An index of at most ``BROADCAST_SEEDS`` rows
    is broadcast, so that the probes aren't shuffled.
    """
    near = ranked(index, cfg)
    near = near if near is index else cut(near)
    near = near.filter(F.col("rank") <= cfg.most_per_probe).drop("rank")
    if near.count() <= BROADCAST_SEEDS:
        near = F.broadcast(near)
    joined = probed.join(near, "key44")
    order = Window.partitionBy(*READ).orderBy("is_rev", "qpos", "ref_id", "pos")
    kept = joined.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= cfg.most_per_read)
    return kept.select(*READ, "is_rev", "qpos", "ref_id", "pos", (F.col("pos") - F.col("qpos")).alias("diag"), "full")


def diagonal_votes(hits: DataFrame) -> DataFrame:
    """Votes of each diagonal, with the probe and place of its first hit in one number, and whether a probe was full."""
    return hits.groupBy(*READ, "ref_id", "is_rev", "diag").agg(
        F.count("*").alias("votes"), F.min(F.shiftleft(F.col("qpos").cast("bigint"), 32) + F.col("pos")).alias("first"), F.max("full").alias("full")
    )


def best_diagonals(votes: DataFrame, also: list[str] | None = None) -> DataFrame:
    """The commonest diagonal of each (read, reference, strand); the one met first wins ties. ``also``: further columns to keep."""
    order = Window.partitionBy(*READ, "ref_id", "is_rev").orderBy(F.desc("votes"), "first")
    first = votes.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return first.select(*READ, "ref_id", "is_rev", "diag", "votes", F.shiftright("first", 32).cast("int").alias("anchor"), *(also or []))


def top_candidates(hits: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """The two groups with most votes of each read, if they have enough, with ``mapq``.

    Columns: read, ``vote_rank`` (1, 2), ref_id, is_rev, diag, votes, anchor, mapq. The
    confidence of the first follows from its lead over the second relative to all hits;
    the second has none. Ties go to the lower reference, forward strand first. All
    windows share the partitioning by read, so the hits are shuffled once.
    """
    whole = Window.partitionBy(*READ)
    votes = diagonal_votes(hits).select("*", F.sum("votes").over(whole).alias("hits"), F.max("full").over(whole).alias("any_full"))
    order = whole.orderBy(F.desc("votes"), "ref_id", "is_rev")
    groups = best_diagonals(votes, ["hits", "any_full"]).withColumn("vote_rank", F.row_number().over(order))
    second = F.coalesce(F.lead("votes").over(order), F.lit(0))
    top = groups.withColumn("__second", second).filter((F.col("vote_rank") <= 2) & (F.col("votes") >= cfg.least_votes))
    x = (F.col("votes") - F.col("__second")) / F.greatest(F.col("hits"), F.lit(1))
    wrong = F.greatest(1 / (1 + F.exp(5 * (x - 0.5))), F.lit(1e-6))
    capped = F.col("any_full") | (F.col("hits") >= cfg.most_per_read)
    mapq = F.least(F.round(-10 * F.log10(wrong)), F.when(capped, 30).otherwise(60)).cast("int")
    return top.select(*READ, "vote_rank", "ref_id", "is_rev", "diag", "votes", "anchor", F.when(F.col("vote_rank") == 1, mapq).otherwise(0).alias("mapq"))
