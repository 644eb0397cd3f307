"""Filling fixed-capacity containers by pattern packing with non-negative least squares.

Only a histogram of sizes, bounded by the capacity, reaches the driver:

1. Sizes fall into classes whose width grows with the size; an item counts as the upper
   end of its class, so a pattern of classes never overflows.
2. The smallest items, as many as the space that the classes leave unused and a hundredth
   more, are kept back for step 4. What is fitted then never asks for more containers
   than the tokens need.
3. Repeat counts x >= 0 of patterns (classes that fill a container together) are fitted to
   the histogram h by min |A x - h|, each class weighted by its size. Patterns aren't
   listed all: of all patterns of any number of parts, the one that the fit gains most
   by is found by a knapsack over the classes and enters, until none helps. The counts
   are rounded down, then up where the histogram still holds a whole pattern.
4. The residual is packed as a best fit over the histogram, largest sizes first, into
   the space left in pattern containers and into new ones, whole groups of like
   containers at a time.

The plan says which ranks of each size go to which run of containers; its length
depends on the capacity alone. Items are then numbered within their size by
a count per partition, so no size is gathered anywhere, and look their container up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.runtime import cut

#: A class is as wide as its lower end over the first of these numbers with which what is
#: kept back is small beside the space that it is to fill; else over the last.
GRAINS = (8, 16, 32, 80)
#: Share of the tokens that is kept back for the residual beyond the space that classes leave.
SPARE = 0.01
#: Patterns that may enter a fit.
ROUNDS = 1000
#: Rows (partition, size) of the numbering that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def class_ends(capacity: int, grain: int = GRAINS[0]) -> np.ndarray:
    """Upper ends of the size classes, ascending, the capacity last."""
    ends = [1]
    while ends[-1] < capacity:
        ends.append(min(capacity, ends[-1] + max(1, ends[-1] // grain)))
    return np.array(ends, dtype=np.int64)


def best_pattern(gain: np.ndarray, ends: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often each class stands in the pattern of largest total gain within the capacity, and that gain."""
    shape = np.zeros(len(ends), dtype=np.int64)
    use = np.flatnonzero(gain > 0)
    if not len(use):
        return shape, 0.0
    size, worth = ends[use], gain[use]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for space in range(int(size[0]), capacity + 1):
        each = best[space - size[: fits[space]]] + worth[: fits[space]]
        last[space] = each.argmax()
        best[space] = each[last[space]]
    space = capacity
    while last[space] >= 0:
        shape[use[last[space]]] += 1
        space -= int(size[last[space]])
    return shape, float(best[capacity])


def nnls(a: np.ndarray, h: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method; ``start`` is a solution to begin with."""
    x = np.zeros(a.shape[1]) if start is None else start.astype(float).copy()
    active = x > 0
    while True:
        gain = a.T @ (h - a @ x)
        gain[active] = -np.inf
        if gain.max(initial=-np.inf) <= 1e-9 * max(1.0, float(np.abs(a.T @ h).max(initial=0))):
            return x
        active[int(np.argmax(gain))] = True
        while active.any():
            at = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, at], h, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[at] = fit
                break
            down = fit <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - fit[down], 1e-300))
            x[at] += step * (fit - x[at])
            active[at[down & (x[at] <= 1e-9)]] = False
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0


def fit_patterns(h: np.ndarray, ends: np.ndarray, capacity: int, rounds: int = ROUNDS, enough: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and their repeat counts that fit a histogram of classes.

    The fit ends when no pattern helps or less than the share ``enough`` of the tokens is unexplained.
    """
    weight = ends.astype(float)
    shapes, x = np.zeros((len(ends), 0), dtype=np.int64), np.zeros(0)
    goal = h * weight
    for _ in range(rounds):
        rest = goal - (shapes * weight[:, None]) @ x
        if np.abs(rest).sum() <= enough * goal.sum():
            break
        shape, gain = best_pattern(rest * weight, ends, capacity)
        if gain <= 1e-9 * max(1.0, float(np.abs(goal * weight).max())) or (shapes == shape[:, None]).all(axis=0).any():
            break
        shapes, x = np.column_stack([shapes, shape]), np.append(x, 0.0)
        x = nnls(shapes * weight[:, None], goal, x)
        shapes, x = shapes[:, x > 0], x[x > 0]
    return shapes, x


def rounded(shapes: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram holds: rounded down, then up, largest fractions first, where it lasts."""
    left, n = h.astype(np.int64), np.zeros(len(x), dtype=np.int64)
    whole = np.floor(x + 1e-6).astype(np.int64)
    for wanted, order in ((whole, np.argsort(-whole, kind="stable")), (np.ones_like(whole), np.argsort(whole - x, kind="stable"))):
        for j in order:
            need = shapes[:, j]
            k = int(min(wanted[j], np.min(left[need > 0] // need[need > 0])))
            n[j] += k
            left -= k * need
    return n


@dataclass
class Plan:
    """Rows (size, first rank, first container, offset, whether by a pattern); each reaches to the next row of its size."""

    size: np.ndarray
    rank: np.ndarray
    container: np.ndarray
    offset: np.ndarray
    by_pattern: np.ndarray
    containers: int


def to_fit(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the classes, and the histogram over them without what is kept back."""
    tokens = int(counts @ np.arange(capacity + 1))
    for grain in GRAINS:
        ends = class_ends(capacity, grain)
        of = np.searchsorted(ends, np.arange(capacity + 1))
        h = np.bincount(of[1:], weights=counts[1:], minlength=len(ends)).astype(np.int64)
        over, largest = int(h @ ends) - -(-tokens // capacity) * capacity + int(SPARE * tokens), 0
        for c in range(len(ends)):
            n = min(int(h[c]), -(-over // int(ends[c]))) if over > 0 else 0
            h[c] -= n
            over -= n * int(ends[c])
            largest = int(ends[c]) if n else largest
        if largest <= capacity // 32:
            break
    return ends, h


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """Plan for ``counts[size]`` items of each size from 1 to the capacity."""
    left = counts.astype(np.int64).copy()
    done = np.zeros(capacity + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int, bool]] = []
    free_groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    containers = int(left[capacity])  # items that fill a container alone

    def place(size: int, first: int, n: int, offset: int, by_pattern: bool) -> None:
        rows.append((size, int(done[size]), first, offset, by_pattern))
        done[size] += n
        left[size] -= n

    def repeat(shape: np.ndarray, n: int) -> None:
        """Fills ``n`` new containers by a pattern, larger classes and sizes first; the last part takes what the others left of it."""
        nonlocal containers
        runs = [(containers, n, 0)]  # first container, number, filled so far
        containers += n
        parts = np.repeat(np.flatnonzero(shape)[::-1], shape[shape > 0][::-1])
        for i, c in enumerate(parts):
            out, final = [], i == len(parts) - 1
            for first, many, filled in runs:
                size = capacity - filled if final else int(ends[c])
                while many:
                    while size and not left[size]:
                        size -= 1
                    k = int(min(many, left[size])) if size else many
                    if size:
                        place(size, first, k, filled, True)
                    out.append((first, k, filled + size))
                    first, many = first + k, many - k
            runs = out
        for first, many, filled in runs:
            free_groups[capacity - filled].append((first, many))

    if containers:
        place(capacity, 0, containers, 0, False)
    ends, h = to_fit(left, capacity)
    if h.any():
        shapes, x = fit_patterns(h, ends, capacity)
        for j, n in enumerate(rounded(shapes, x, h)):
            if n:
                repeat(shapes[:, j], int(n))
    for size in range(capacity, 0, -1):
        while left[size]:
            fit = next((f for f in range(size, capacity + 1) if free_groups[f]), None)
            if fit is None:
                per = capacity // size
                many = max(1, int(left[size]) // per)
                k = min(per, int(left[size]))
                for i in range(k):
                    place(size, containers, many, i * size, False)
                free_groups[capacity - k * size].append((containers, many))
                containers += many
                continue
            first, many = free_groups[fit].pop()
            k = int(min(many, left[size]))
            place(size, first, k, capacity - fit, False)
            free_groups[fit - size].append((first, k))
            if k < many:
                free_groups[fit].append((first + k, many - k))
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T[:4], table[:, 4].astype(bool), containers)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the number of each row among those of its size in it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        order = np.argsort(size, kind="stable")
        values, starts, many = np.unique(size[order], return_index=True, return_counts=True)
        local = np.empty(len(size), dtype=np.int64)
        base = np.array([seen.get(int(v), 0) for v in values], dtype=np.int64)
        local[order] = np.arange(len(size)) - np.repeat(starts, many) + np.repeat(base, many)
        for v, b, n in zip(values, base, many):
            seen[int(v)] = int(b + n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(local)], names=[*batch.schema.names, "part", "local"]
        )


def _placed(plan: Plan):
    """Task function: container and offset of each row by its size and rank."""
    keys = plan.size * (1 << 48) + plan.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            size, rank = get("size"), get("rank")
            at = np.searchsorted(keys, size * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(2)],
                    pa.array(size),
                    pa.array(plan.container[at] + rank - plan.rank[at]),
                    pa.array(plan.offset[at]),
                    pa.array(plan.by_pattern[at]),
                ],
                names=["item", "piece", "size", "container", "start", "by_pattern"],
            )

    return run


def pack_items(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``item``, ``piece``, ``size``, ``container``, ``start`` and ``by_pattern`` of every placed piece.

    Every row of ``df`` of size 1 or more is placed once: whole in one container, or,
    if it alone exceeds the capacity, as pieces 0, 1, ... of which all but the last fill
    a container. Rows of null size or size below 1 are not placed; rows with the same
    or a null item are separate items. ``start`` is the place in the container;
    ``by_pattern`` tells pieces of fitted patterns from the residual and from pieces that
    fill a container alone. An empty table gives an empty result. Other columns are left out.
    """
    sizes = df.filter(F.col(size) >= 1).select(F.col(item).cast("bigint").alias("item"), F.col(size).cast("bigint").alias("whole"))
    pieces = sizes.select("item", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(whole - 1) div {capacity}"))).alias("piece"))
    pieces = pieces.select("item", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("piece") * capacity).alias("size"))
    numbered = cut(pieces.mapInArrow(_numbered, "item bigint, piece bigint, size bigint, part int, local bigint"))
    by_part = cut(numbered.groupBy("part", "size").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["size"]] = row["n"]
    plan = plan_packing(counts, capacity)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if by_part.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = numbered.join(base, ["part", "size"]).select("item", "piece", "size", (F.col("base") + F.col("local")).alias("rank"))
    kinds = "item bigint, piece bigint, size bigint, container bigint, start bigint, by_pattern boolean"
    return ranked.mapInArrow(_placed(plan), kinds)
