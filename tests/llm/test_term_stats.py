import random
from collections import defaultdict

import pytest

from strandframe.llm.term_stats import marked, term_statistics


def brute(rows, weighted):
    seen = defaultdict(dict)
    for term, record, place, weight in rows:
        if term is None or term < 0 or (weighted and (weight is None or weight < 1)):
            continue
        key = (record, None if weighted else place)
        seen[term][key] = max(seen[term].get(key, 0), weight if weighted else 1)
    return {t: (sum(x.values()), len({r for r, _ in x})) for t, x in seen.items()}


def rows(seed):
    rng = random.Random(seed)
    out = [(rng.choice([None, -1, 3, 3, 3, 3, rng.randrange(60)]), rng.choice([None, rng.randrange(9)]), rng.choice([None, rng.randrange(40)]), rng.choice([None, 0, 1, 5, 9])) for _ in range(3000)]
    return out + [(4, 1, 1, 2)] * 3000 + [(2**62, 2**62, 2**30, 2**40)]


@pytest.mark.parametrize("tasks", [1000, 100, 17])
@pytest.mark.parametrize("weighted", [False, True])
def test_against_brute_force(spark, tasks, weighted):
    data = rows(tasks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in data], "t bigint, r bigint, p bigint, w bigint, term string, records int")
        kw = {"weight": "w"} if weighted else {"place": "p"}
        got = term_statistics(df, "t", "r", rows_per_task=tasks, **kw).collect()
        assert {x.term: (x.occurrences, x.records) for x in got} == brute(data, weighted)
        assert len(got) == len(brute(data, weighted))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(1, 1, i) for i in range(4)] + [(2, 1, 0), (2, 2, 0), (3, 5, 5)], "t bigint, r bigint, p bigint")
    got = {x.term: x.mark for x in marked(term_statistics(df, "t", "r", place="p"), 3).collect()}
    assert got == {1: "common", 2: None, 3: "rare"}
    assert term_statistics(df.limit(0), "t", "r", place="p").count() == 0
