"""Evaluation of SAM files whose read names carry the reads' origins."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import evaluation as E
from strandframe.sources.fastx import read_sam


def evaluate(spark: SparkSession, runs: Mapping[str, str], tolerance: int = 10) -> tuple[DataFrame, DataFrame]:
    """Accuracy of each tool, and the first false places; ``runs`` gives the SAM files of the tools.

    Every read of any file counts for every tool. Of several primary records of a mate the
    one that stands last in its file holds.
    """

    def rows(tool: str, path: str) -> DataFrame:
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        return read_sam(spark, path, place.alias("row_no")).withColumn("tool", F.lit(tool))

    sam = reduce(DataFrame.unionByName, [rows(*run) for run in runs.items()])
    judged = E.judged(E.truth_from_names(sam), E.tool_results(sam), tolerance)
    return E.accuracy(judged), E.first_errors(judged)
