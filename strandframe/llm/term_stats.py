"""Occurrences and records of every distinct term by an external sort and a run-length scan.

Rows of (term, record, place) are range-partitioned and sorted by all three, so
equal terms lie in one run that may go on over several partitions; a term held by
a third of all rows is spread like any other. The bounds come from a sample whose size
follows the number of partitions; one pass over the rows drops copies within a batch and
numbers the partition of each row. Each partition is scanned once in
Arrow batches with constant state. Runs within a partition are final; only the
first and the last run of each partition are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.runtime import cut

#: Rows that one task sorts; the number of partitions follows from the number of rows.
ROWS_PER_TASK = 500_000
#: Rows of the sample that bounds are taken from, for each partition.
SAMPLE = 30

_RUNS = "term bigint, occurrences bigint, records bigint, first_record bigint, last_record bigint, edge boolean, part int"


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def ranged(bounds: list[np.ndarray]):
    """Task function: one row of equal (term, record, place) in a batch, with the largest weight, and the number of its partition.

    A partition begins at its bound; ``bounds`` holds their terms, records and places in ascending order.
    """

    def number(term, record, place):
        low, high = (np.searchsorted(bounds[0], term, side=x) for x in ("left", "right"))
        tied = np.flatnonzero(low < high)  # the term is that of bounds: record and place decide
        if len(tied):
            near = np.flatnonzero(np.isin(bounds[0], term[tied]))
            t, r, p = (np.concatenate([b[near], c[tied]]) for b, c in zip(bounds, (term, record, place)))
            later = np.arange(len(t)) >= len(near)
            order = np.lexsort((later, p, r, t))
            passed = np.empty(len(t), dtype=np.int64)
            passed[order] = np.cumsum(~later[order])
            at = passed[len(near) :]
            low[tied] = np.where(at > 0, near[np.maximum(at, 1) - 1] + 1, low[tied])
            low[tied] = np.maximum(low[tied], np.searchsorted(bounds[0], term[tied], side="left"))
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, record, place, weight = _columns(batch)
            order = np.lexsort((weight, place, record, term))
            t, r, p = term[order], record[order], place[order]
            last = np.ones(len(t), dtype=bool)
            last[:-1] = (t[1:] != t[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])
            kept = [t[last], r[last], p[last]]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, kept), pa.array(weight[order][last]), pa.array(number(*kept).astype(np.int32))], names=["term", "record", "place", "weight", "range"]
            )

    return run


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms of one sorted partition, as rows of ``_RUNS``."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first_seen = False
    held = None  # the run that may go on in the next batch
    tail = None  # its last (term, record, place, weight), not yet counted

    def emit(rows, edge):
        term, occ, rec, lo, hi = rows
        n = len(term)
        return pa.RecordBatch.from_arrays(
            [pa.array(term), pa.array(occ), pa.array(rec), pa.array(lo), pa.array(hi), pa.array(edge), pa.array(np.full(n, part, np.int32))],
            names=["term", "occurrences", "records", "first_record", "last_record", "edge", "part"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        if tail is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(tail, cols)]
        term, record, place, weight = cols
        n = len(term)
        new_term = np.ones(n, dtype=bool)
        new_term[1:] = term[1:] != term[:-1]
        new_record = new_term.copy()
        new_record[1:] |= record[1:] != record[:-1]
        # Of equal rows the last counts, as the weights ascend.
        closes = np.ones(n, dtype=bool)
        closes[:-1] = new_record[1:] | (place[1:] != place[:-1])
        closes[-1] = False  # it may be repeated in the next batch
        starts = np.flatnonzero(new_term)
        occ = np.add.reduceat(np.where(closes, weight, 0), starts)
        rec = np.add.reduceat(new_record.astype(np.int64), starts)
        ends = np.append(starts[1:], n) - 1
        runs = [term[starts], occ, rec, record[starts], record[ends]]
        if held is not None:  # the first row of this batch is the tail, so the first run is the held one
            runs[1][0] += held[1]
            runs[2][0] += held[2] - 1  # the tail's record was counted before
            runs[3][0] = held[3]
        tail = [c[-1] for c in cols]
        held = [c[-1] for c in runs]
        if len(starts) > 1:
            edge = np.zeros(len(starts) - 1, dtype=bool)
            edge[0] = not first_seen
            first_seen = True
            yield emit([c[:-1] for c in runs], edge)
    if held is not None:
        held[1] += tail[3]
        yield emit([np.array([x]) for x in held], np.array([True]))


def term_statistics(
    df: DataFrame, term: str, record: str, place: str | None = None, weight: str | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``term``, ``occurrences`` and ``records`` of every distinct term of ``df``.

    An occurrence is a distinct (term, record, place), or a distinct (term, record)
    that counts ``weight`` times; of repeated ones with different weights the largest
    holds. Rows with a null or negative term are no terms, rows with a null weight or
    one below 1 count nothing. A null record is a record of its own, a null place a
    place of its own (both are taken as the smallest bigint). An empty table gives an
    empty result. Other columns are left out, whatever their names.
    """
    lowest = F.lit(-(2**63))
    at = lambda c: F.coalesce(F.col(c).cast("bigint"), lowest) if c else F.lit(0).cast("bigint")
    heavy = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    pairs = df.filter(F.col(term) >= 0)
    if weight:
        pairs = pairs.filter(F.col(weight) >= 1)
    pairs = pairs.select(F.col(term).cast("bigint").alias("term"), at(record).alias("record"), at(place).alias("place"), heavy.alias("weight"))
    rows = pairs.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task))
    sample = pairs.sample(min(1.0, SAMPLE * tasks / max(rows, 1)), seed=1).select("term", "record", "place").toArrow()
    cols = [sample[i].to_numpy() for i in range(3)]
    order = np.lexsort(cols[::-1])
    picked = order[(np.arange(1, tasks) * len(order)) // tasks] if len(order) else order
    bounds = [c[picked] for c in cols]
    runs = cut(
        pairs.mapInArrow(ranged(bounds), "term bigint, record bigint, place bigint, weight bigint, range int")
        .repartitionById(tasks, F.col("range"))
        .sortWithinPartitions("term", "record", "place", "weight")
        .drop("range")
        .mapInArrow(scan_runs, _RUNS)
    )
    # A record that ends one partition and begins the next is one record.
    parts = F.array_sort(F.collect_list(F.struct("part", "first_record", "last_record")))
    same = F.filter(
        F.transform("__parts", lambda x, i: (i > 0) & (x["first_record"] == F.get(F.col("__parts"), i - 1)["last_record"])),
        lambda same: same,
    )
    edges = (
        runs.filter("edge")
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("__records"), parts.alias("__parts"))
        .select("term", "occurrences", (F.col("__records") - F.size(same)).alias("records"))
    )
    return runs.filter("not edge").select("term", "occurrences", "records").unionByName(edges)


def marked(stats: DataFrame, common_above: int) -> DataFrame:
    """Adds ``mark``: ``common`` above so many occurrences, else ``rare`` in one record only, else null."""
    mark = F.when(F.col("occurrences") > common_above, "common").when(F.col("records") == 1, "rare")
    return stats.select("term", "occurrences", "records", mark.alias("mark"))
