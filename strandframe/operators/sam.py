"""SAM-shaped rows, text and headers of mapped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.functions.sequences import cigar_text, oriented

COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nm", "as_score", "rg"]


def sam_rows(reads: DataFrame, resolved: DataFrame, references: DataFrame, style: str = "cli", cfg: MapperConfig = CONFIG) -> DataFrame:
    """SAM columns, with ``read_id``, ``mate`` and ``ref_id``: one row per mate of ``reads`` (``read_id, name, seq1, qual1, seq2, qual2``).

    A read without a second sequence gives a single row. Unmapped rows have no place,
    also if the mate is mapped. Style ``cli``: RNEXT ``=`` on the same reference, a read
    group column. Style ``plain``: RNEXT always a name, no template length, no group.
    A missing quality is ``*``; a null name is ``*``.
    """
    if style not in ("cli", "plain"):
        raise ValueError("style must be cli or plain")
    names = references.select(F.col("ref_id").alias("__id"), F.col("ref_name").alias("__name"))
    base = reads.select("read_id", "name", "seq1", "qual1", "seq2", "qual2").filter((F.length("seq1") > 0) | (F.length("seq2") > 0)).join(resolved, "read_id", "left")
    paired = F.length("seq2") > 0
    sides = F.array(
        *[
            F.struct(
                F.lit(m).alias("mate"), F.coalesce(F.col(f"seq{m}"), F.lit("")).alias("s"), F.coalesce(F.col(f"qual{m}"), F.lit("*")).alias("q"),
                F.col(f"r{m}").alias("r"), F.col(f"r{3 - m}").alias("o"), (F.coalesce("tlen", F.lit(0)) * (1 if m == 1 else -1)).alias("t"),
            )
            for m in (1, 2)
        ]
    )
    rows = base.select("read_id", "name", paired.alias("paired"), F.coalesce("proper", F.lit(False)).alias("proper"), F.explode(sides).alias("x"))
    rows = rows.filter(F.coalesce("paired", F.lit(False)) | (F.col("x.mate") == 1)).select("read_id", "name", F.coalesce("paired", F.lit(False)).alias("paired"), "proper", "x.*")
    rows = rows.withColumn("ref_id", F.col("r.ref_id")).withColumn("mate_ref", F.col("o.ref_id"))
    rows = rows.join(names, F.col("ref_id") == F.col("__id"), "left").drop("__id").withColumnRenamed("__name", "rname")
    rows = rows.join(names, F.col("mate_ref") == F.col("__id"), "left").drop("__id").withColumnRenamed("__name", "mname")
    mapped, other = F.col("r").isNotNull(), F.col("o").isNotNull()
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    own = bit(~mapped, 4) + bit(mapped & F.col("r.is_rev"), 16)
    pair = 1 + bit(F.col("proper") & mapped & other, 2) + bit(~other, 8) + bit(other & F.col("o.is_rev"), 32) + F.when(F.col("mate") == 1, 64).otherwise(128)
    flag = F.when(F.col("paired"), own + pair).otherwise(own)
    seq, qual = oriented(F.col("s"), F.col("q"), mapped & F.col("r.is_rev"))
    there = F.col("paired") & other
    same = F.lit("=") if style == "cli" else F.col("mname")
    rnext = F.when(there & mapped & (F.col("ref_id") == F.col("mate_ref")), same).when(there, F.col("mname")).otherwise("*")
    return rows.select(
        "read_id", "mate", "ref_id",
        F.coalesce("name", F.lit("*")).alias("qname"),
        flag.cast("int").alias("flag"),
        F.coalesce("rname", F.lit("*")).alias("rname"),
        F.coalesce(F.col("r.pos") + 1, F.lit(0)).alias("pos"),
        F.coalesce("r.mapq", F.lit(0)).alias("mapq"),
        F.when(mapped, cigar_text(F.col("r.cigar"))).otherwise("*").alias("cigar"),
        rnext.alias("rnext"),
        F.when(there, F.col("o.pos") + 1).otherwise(0).alias("pnext"),
        (F.when(F.col("paired"), F.col("t")).otherwise(0) if style == "cli" else F.lit(0)).cast("int").alias("tlen"),
        seq.alias("seq"), qual.alias("qual"),
        F.col("r.nm").alias("nm"), F.col("r.as_score").alias("as_score"),
        (F.lit(cfg.read_group) if style == "cli" else F.lit(None).cast("string")).alias("rg"),
    )


def sam_lines(rows: DataFrame) -> DataFrame:
    """``value``: the text line of each SAM row."""
    tag = lambda c, t: F.when(F.col(c).isNotNull(), F.concat(F.lit(t), F.col(c).cast("string")))
    return rows.select(F.concat_ws("\t", *COLUMNS[:11], tag("nm", "NM:i:"), tag("as_score", "AS:i:"), tag("rg", "RG:Z:")).alias("value"))


def sam_header(references: DataFrame, sort_order: str = "unsorted", cfg: MapperConfig = CONFIG) -> DataFrame:
    """``line_no`` and ``value`` of the header; references in the order of their ids.

    ``line_no`` of a reference line is its id, so no global numbering is needed: order
    by (``part``, ``line_no``).
    """
    if sort_order not in ("unsorted", "coordinate"):
        raise ValueError("sort order must be unsorted or coordinate")
    spark = references.sparkSession
    fixed = [(0, 0, f"@HD\tVN:1.6\tSO:{sort_order}"), (2, 0, f"@RG\tID:{cfg.read_group}\tSM:sample\tPL:ILLUMINA"), (2, 1, "@PG\tID:strandframe\tPN:strandframe")]
    ends = spark.createDataFrame(fixed, "part int, line_no bigint, value string")
    lines = F.concat(F.lit("@SQ\tSN:"), "ref_name", F.lit("\tLN:"), F.length("seq").cast("string"))
    return ends.unionByName(references.filter(F.length("seq") > 0).select(F.lit(1).alias("part"), F.col("ref_id").alias("line_no"), lines.alias("value")))


def coordinate_sorted(rows: DataFrame) -> DataFrame:
    """By reference and place, unmapped rows last; ties by name and mate."""
    return rows.orderBy(F.col("ref_id").asc_nulls_last(), "pos", "qname", "mate")


def write_sam(rows: DataFrame, references: DataFrame, path: str, sort: bool = False) -> None:
    """Header and body as text files of one folder, the header in ``header``, the body in ``body``."""
    sam_header(references, "coordinate" if sort else "unsorted").orderBy("part", "line_no").select("value").write.mode("overwrite").text(f"{path}/header")
    sam_lines(coordinate_sorted(rows) if sort else rows).write.mode("overwrite").text(f"{path}/body")
