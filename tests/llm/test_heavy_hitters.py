import random

import numpy as np

from strandframe.llm.heavy_hitters import HALVES, WORD, decode, encode, heavy_hitters


def test_code_corrects_two_symbols_of_each_half():
    rng = np.random.default_rng(3)
    values = np.append(rng.integers(0, 2**63 - 1, 60), [0, 1, 2**63 - 1])
    words = encode(values)
    for k, v in enumerate(values):
        assert decode(words[:, :, k]) == v
        wrong = words[:, :, k].copy()
        for h in range(HALVES):
            for j in rng.choice(WORD, 2, replace=False):
                wrong[h, j] = (wrong[h, j] + rng.integers(1, 16)) % 16
        assert decode(wrong) == v


def brute(rows, share, total=None):
    sums = {}
    for v, w in rows:
        if v is not None and v >= 0 and w is not None and w >= 1:
            sums[v] = sums.get(v, 0) + w
    total = total or sum(sums.values())
    return {v: w for v, w in sums.items() if w >= share * total}


def run(spark, rows, share, **kw):
    df = spark.createDataFrame([(v, w, "x") for v, w in rows], "v bigint, w bigint, value string")
    return {r.value: r.weight for r in heavy_hitters(df, "v", share, weight="w", **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2**44), 1) for _ in range(3000)] + [(None, 50), (-1, 99), (5, None), (5, 0), (5, -3)]
    for k in range(12):
        rows += [(k * 10**12 + 7, 1)] * (20 * (k + 1))
    rows += [(7, 2000)] * 2
    assert run(spark, rows, 0.02) == brute(rows, 0.02)
    assert run(spark, rows, 0.004) == brute(rows, 0.004)


def test_crowded_groups_stay_whole(spark):
    # As many frequent values as the share admits, so that groups hold several.
    rows = [(k * 7919, 10) for k in range(40)]
    assert run(spark, rows, 1 / 40) == brute(rows, 1 / 40)
    assert run(spark, rows, 1 / 40, repetitions=1) == brute(rows, 1 / 40)


def test_empty_and_without_values(spark):
    assert run(spark, [], 0.1) == {}
    assert run(spark, [(None, 1), (-4, 2)], 0.1) == {}
    assert run(spark, [(3, 1)], 0.1) == {3: 1}
