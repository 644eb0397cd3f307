"""Reads mapped as their files arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandframe.plans.map_reads import map_reads
from strandframe.sources.fastx import read_pairs, read_single

FILES = "path string, modificationTime timestamp, length bigint, content binary"
READS = "read_id bigint, name string, seq1 string, qual1 string, seq2 string, qual2 string"


def map_stream(
    spark: SparkSession, source: str, index: DataFrame, references: DataFrame, sink: str, checkpoint: str, files_per_trigger: int = 16
) -> StreamingQuery:
    """Map each new Parquet file of reads below ``source`` and append its SAM rows to ``sink``, one folder per batch.

    Ranking windows aren't allowed on a stream, so each micro-batch runs the batch plan.
    A batch that is run again after a failure overwrites its own folder, so no row is
    written twice. ``files_per_trigger`` bounds a batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        map_reads(batch, index, references).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def map_fastq_stream(
    spark: SparkSession, source: str, index: DataFrame, references: DataFrame, sink: str, checkpoint: str, first: str = "_1", second: str | None = "_2",
    files_per_trigger: int = 16, available_now: bool = True,
) -> StreamingQuery:
    """Map FASTQ files as they arrive below ``source`` and append their SAM rows to ``sink``, one folder per batch.

    Spark keeps account of the files, whose contents it doesn't read; a batch has at most
    ``files_per_trigger`` of them, and reads them in ranges. A pair is taken when the
    file whose name ends in ``first`` arrives, so its mate, with ``second`` instead, must be
    there before; ``second`` None: all files are single reads. A batch that is run again
    overwrites its own folder. ``available_now``: end when all present files are mapped.
    """

    def one(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())  # bounded by files_per_trigger
        if not paths:
            return
        if second is None:
            reads = read_single(spark, ",".join(paths))
        else:
            mate = [re.sub(rf"{re.escape(first)}(\.[^/]*)$", rf"{second}\1", p) for p in paths]
            reads = read_pairs(spark, ",".join(paths), ",".join(mate))
        map_reads(reads, index, references).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger)
    if second is not None:
        files = files.option("pathGlobFilter", f"*{first}.*")
    writer = files.load(source).select("path").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """Running totals of what has been mapped, by batch."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("batch").agg(F.count("*").alias("reads"), F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"))
