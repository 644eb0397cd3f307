"""The seed index: a table of (key44, ref_id, pos) without over-frequent seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.operators.syncmers import explode_syncmers
from strandframe.runtime import cut


def remainder(key44: Column) -> Column:
    """Lower 24 bits of a key."""
    return key44.bitwiseAND(0xFFFFFF)


def bucket(key44: Column) -> Column:
    """Upper 20 bits of a key."""
    return F.shiftrightunsigned(key44, 24)


def remainder_counts(seeds: DataFrame) -> DataFrame:
    """Number of seeds of each remainder, over all buckets."""
    return seeds.groupBy(remainder(F.col("key44")).alias("rem24")).agg(F.count("*").alias("n"))


def without_frequent(seeds: DataFrame, most: int) -> DataFrame:
    """Seeds whose remainder occurs at most ``most`` times.

    Only the remainders above that are joined, of which there are at most
    seeds / ``most``; a hot remainder is dropped by an anti join.
    """
    over = remainder_counts(seeds).filter(F.col("n") > most).select(F.col("rem24").alias("__rem"))
    return seeds.join(over, remainder(F.col("key44")) == F.col("__rem"), "left_anti")


def build_index(references: DataFrame, ref_id: str = "ref_id", seq: str = "seq", cfg: MapperConfig = CONFIG) -> DataFrame:
    """``key44``, ``ref_id``, ``pos`` of the seeds of all references. Null and short sequences have none.

    The seeds are taken from the sequences and written once, then counted and filtered.
    """
    ids = references.select(F.col(ref_id).alias("ref_id"), F.col(seq).alias("seq"))
    raw = cut(explode_syncmers(ids, ["ref_id"], "seq", cfg=cfg).select("key44", "ref_id", "pos"))
    return without_frequent(raw, cfg.most_per_remainder)


def bucket_offsets(index: DataFrame) -> DataFrame:
    """``bucket``, ``n`` and ``first``: the number of seeds before each bucket that holds any.

    The running sum is taken in two steps, within and over groups of buckets, so that
    no window holds more than 1,024 rows.
    """
    sizes = index.groupBy(bucket(F.col("key44")).alias("bucket")).agg(F.count("*").alias("n")).withColumn("g", F.shiftright("bucket", 10))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("gn"))
    before = Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(groups, "g").select("bucket", "n", (F.col("base") + F.col("inner")).alias("first"))


def ranked(index: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """Index rows with ``rank``, their place among those of their key, and ``full``: whether the key has at least as many as a probe takes.

    A probe takes the first ones by (ref_id, pos); so the limit is applied to the index
    once instead of to every probe. A key has at most ``most_per_remainder`` rows. A written
    index has these columns already.
    """
    if "full" in index.columns:
        return index
    order = Window.partitionBy("key44").orderBy("ref_id", "pos")
    rows = index.withColumn("rank", F.row_number().over(order))
    whole = F.max("rank").over(Window.partitionBy("key44"))
    return rows.withColumn("full", whole >= cfg.most_per_probe).select("key44", "ref_id", "pos", "rank", "full")


def write_index(index: DataFrame, path: str, cfg: MapperConfig = CONFIG) -> None:
    """Parquet, ranged and sorted by key, so that row groups are skipped when a few keys are read; with the ranks that seeding needs."""
    ranked(index, cfg).repartitionByRange("key44").sortWithinPartitions("key44", "ref_id", "pos").write.mode("overwrite").parquet(path)


def read_index(spark, path: str, ranks: bool = False) -> DataFrame:
    """The index that ``write_index`` wrote; with its ranks, mapping needn't number it again."""
    return spark.read.schema("key44 bigint, ref_id bigint, pos int" + (", rank int, full boolean" if ranks else "")).parquet(path)
