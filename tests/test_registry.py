import os

import pytest

from strandframe.plans import registry

DATA = "/root/testdata/sf0.001"


def test_twins_belong_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) == 59


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_twins_agree_on_the_smallest_tables(spark):
    import duckdb

    from tools.compare import normal

    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    for name in ("syncmers", "top2_groups", "pair_best", "sam_paired", "eval_metrics", "venn3_counts", "p5_found", "index_bucket_offsets", "multipass_first"):
        got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.SQL[name]).df()
        assert normal(got) == normal(want), name
        assert len(got), name


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
