"""The whole way from reads to SAM rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.operators.extension import extend_candidates
from strandframe.operators.index import build_index, read_index, write_index
from strandframe.operators.multipass import map_in_passes
from strandframe.operators.pairing import first_alignments, resolve_pairs
from strandframe.operators.sam import coordinate_sorted, sam_rows
from strandframe.operators.seeding import probes, seed_hits, top_candidates


def align(reads: DataFrame, index: DataFrame, references: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """Up to two alignments of each mate."""
    hits = seed_hits(probes(reads, cfg), index, cfg)
    return extend_candidates(top_candidates(hits, cfg), reads, references, cfg)


def map_reads(
    reads: DataFrame, index: DataFrame, references: DataFrame, pairing: str = "best", style: str = "cli", sort: bool = False, cfg: MapperConfig = CONFIG
) -> DataFrame:
    """SAM rows of ``reads`` (``read_id, name, seq1, qual1, seq2, qual2``) placed on ``references`` (``ref_id, ref_name, seq``).

    A null or empty ``seq2`` makes a read single; a read without any sequence has no row.
    ``pairing`` is ``best`` or ``none``, ``style`` that of ``sam_rows``.
    """
    found = align(reads, index, references, cfg)
    resolved = resolve_pairs(found, cfg) if pairing == "best" else first_alignments(found)
    rows = sam_rows(reads, resolved, references, style, cfg)
    return coordinate_sorted(rows) if sort else rows


def map_reads_in_passes(
    reads: DataFrame, references: DataFrame, letters: int, pairing: str = "none", style: str = "plain", sort: bool = False, cfg: MapperConfig = CONFIG
) -> DataFrame:
    """SAM rows with references taken in passes of about ``letters`` letters; the first pass that maps a mate wins. Options as in ``map_reads``."""
    found = map_in_passes(reads, references, letters, lambda r, refs: align(r, build_index(refs, cfg=cfg), refs, cfg)).drop("ref_pass")
    resolved = resolve_pairs(found, cfg) if pairing == "best" else first_alignments(found)
    rows = sam_rows(reads, resolved, references, style, cfg)
    return coordinate_sorted(rows) if sort else rows


class MappingSession:
    """References and index kept for several batches of reads, with running totals.

    The index is written once below ``path``, a folder that all executors share, and
    read by every batch.
    """

    def __init__(self, references: DataFrame, path: str, cfg: MapperConfig = CONFIG):
        self.spark, self.cfg, self.path = references.sparkSession, cfg, path
        references.select("ref_id", "ref_name", "seq").write.mode("overwrite").parquet(f"{path}/references")
        self.references = self.spark.read.parquet(f"{path}/references")
        write_index(build_index(self.references, cfg=cfg), f"{path}/seeds")
        self.index = read_index(self.spark, f"{path}/seeds", ranks=True)
        self.totals = {"reads": 0, "mapped": 0, "bases": 0, "mapped_bases": 0, "seconds": 0.0}

    def map_to(self, reads: DataFrame, output: str, **options) -> dict[str, float]:
        """Map a batch, write its SAM rows as Parquet, and return the totals so far with reads and megabases per second.

        The counts are observed while the rows are written; nothing is read again.
        """
        seen, began = Observation(), time.monotonic()
        mapped = F.col("flag").bitwiseAND(4) == 0
        rows = map_reads(reads, self.index, self.references, cfg=self.cfg, **options).observe(
            seen, F.count("*").alias("reads"), F.count_if(mapped).alias("mapped"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"),
            F.coalesce(F.sum(F.when(mapped, F.length("seq"))), F.lit(0)).alias("mapped_bases"),
        )
        rows.write.mode("append").parquet(output)
        for name, value in seen.get.items():
            self.totals[name] += value
        self.totals["seconds"] += time.monotonic() - began
        seconds = max(self.totals["seconds"], 1e-9)
        return self.totals | {"reads_per_second": self.totals["reads"] / seconds, "megabases_per_second": self.totals["bases"] / 1e6 / seconds}
