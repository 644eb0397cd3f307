import random
from collections import defaultdict

import numpy as np
import pytest

from strandframe.llm.packing import best_pattern, class_ends, fit_patterns, nnls, pack_items, plan_packing, rounded


def check(rows, placed, capacity):
    """Every item is placed once, nothing overlaps and no container overflows."""
    want = defaultdict(int)
    for item, size in rows:
        if size is not None and size >= 1:
            want[item] += size
    got, containers = defaultdict(int), defaultdict(list)
    for r in placed:
        got[r.item] += r.size
        containers[r.container].append((r.start, r.size))
        assert 1 <= r.size <= capacity
    assert got == want
    whole = defaultdict(list)
    for r in placed:
        whole[r.item].append(r)
    for item, size in rows:
        if size and size > capacity and sum(x[0] == item for x in rows) == 1:
            parts = sorted(whole[item], key=lambda r: r.piece)
            assert [p.piece for p in parts] == list(range(-(-size // capacity)))
            assert all(p.size == capacity for p in parts[:-1])
        elif size and size >= 1 and sum(x[0] == item for x in rows) == 1:
            assert [p.size for p in whole[item]] == [size]
    for spans in containers.values():
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at <= capacity
    return sum(want.values()) / max(1, len(containers)) / capacity


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, min(5 * capacity, int(rng.lognormvariate(0, 1.3) * capacity / 12))) for i in range(4000)]
    rows += [(9000 + i, 7) for i in range(2000)]  # a third of all items is alike
    rows += [(None, 3), (None, 3), (1, 4), (1, 4), (20001, None), (20002, 0), (20003, -5), (20004, capacity), (20005, capacity * 100 + 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "item bigint, tokens bigint, size int, part string").repartition(5)
    fill = check(rows, pack_items(df, "item", "tokens", capacity).collect(), capacity)
    assert fill > 0.99


def test_empty(spark):
    df = spark.createDataFrame([], "item bigint, tokens bigint")
    assert pack_items(df, "item", "tokens", 100).count() == 0


def placed_by_patterns(plan, counts):
    """Shares of the items and of the tokens, items that fill a container alone not counted."""
    last = np.append(plan.size[1:] != plan.size[:-1], True)
    n = np.where(last, counts[plan.size], np.append(plan.rank[1:], 0)) - plan.rank
    some = plan.size < len(counts) - 1
    tokens = n * plan.size
    assert tokens.sum() == counts @ np.arange(len(counts))
    return n[plan.by_pattern].sum() / n[some].sum(), tokens[plan.by_pattern].sum() / tokens[some].sum()


@pytest.mark.parametrize("many", [10_000, 1_000_000])
def test_patterns_place_most(many):
    sizes = np.random.default_rng(7).lognormal(4.3, 1.2, many).astype(np.int64)
    counts = np.bincount(sizes[(sizes > 0) & (sizes <= 2048)], minlength=2049)
    plan = plan_packing(counts, 2048)
    items, tokens = placed_by_patterns(plan, counts)
    assert items > 0.5 and tokens > 0.8
    assert plan.containers <= 1.002 * -(-(counts @ np.arange(2049)) // 2048)


def test_plan_of_large_items():
    counts = np.zeros(2049, dtype=np.int64)
    np.add.at(counts, np.random.default_rng(1).integers(1, 2049, 100_000), 1)
    plan = plan_packing(counts, 2048)
    assert (np.arange(2049) * counts).sum() / 2048 / plan.containers > 0.97


@pytest.mark.parametrize("counts", [[0, 5], [0, 0, 3], [0, 1, 0, 1], [0] * 64 + [1], [0, 10**12] + [0] * 62 + [7]])
def test_plan_of_few_sizes(counts):
    counts = np.array(counts)
    plan = plan_packing(counts, len(counts) - 1)
    assert plan.containers == -(-(counts @ np.arange(len(counts))) // (len(counts) - 1))


def test_best_pattern_against_all():
    ends = class_ends(20, 4)
    assert ends[0] == 1 and ends[-1] == 20 and (np.diff(ends) > 0).all()
    gain = np.random.default_rng(2).normal(size=len(ends))

    def all_(space, most):
        yield 0.0
        for c in range(most + 1):
            if ends[c] <= space:
                yield from (gain[c] + g for g in all_(space - ends[c], c))

    shape, worth = best_pattern(gain, ends, 20)
    assert shape @ ends <= 20 and abs(shape @ gain - worth) < 1e-9 and abs(worth - max(all_(20, len(ends) - 1))) < 1e-9
    assert best_pattern(-np.ones(len(ends)), ends, 20)[1] == 0


def test_fit_and_rounding():
    ends = class_ends(64)
    h = np.random.default_rng(3).integers(0, 200, len(ends))
    shapes, x = fit_patterns(h, ends, 64)
    assert (x > 0).all() and (shapes.T @ ends <= 64).all()
    n = rounded(shapes, x, h)
    assert (shapes @ n <= h).all() and (shapes @ n) @ ends > 0.8 * (h @ ends)


def test_nnls():
    rng = np.random.default_rng(4)
    a = rng.random((12, 30))
    x = np.maximum(rng.normal(size=30), 0)
    h = a @ x
    fit = nnls(a, h)
    assert fit.min() >= 0 and np.linalg.norm(a @ fit - h) < 1e-6
    h = rng.normal(size=12)
    fit = nnls(a, h)
    gain = a.T @ (h - a @ fit)
    assert gain.max() < 1e-6 and abs(gain @ fit) < 1e-6
