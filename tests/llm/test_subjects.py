import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm.subjects import TopicSettings, assign_subjects, clusters, exp_digamma, name_topics, sentences

WORDS = {s: [f"{s}{a}{b}" for a in "bcdf" for b in "aeiou"] for s in ("red", "green", "blue", "grey")}
COMMON = ["the", "with", "was", "near"]


def sentence(rng, subject, words=None):
    picked = rng.sample(words or WORDS[subject], 3) if subject else rng.sample(["moved", "meeting", "page", "below", "day"], 3)
    return f"The {picked[0]} was near {picked[1]} with the {picked[2]}" + rng.choice([".", "!", "?", '!"'])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    # The examples lack a third of each subject's words.
    examples = [(sentence(rng, s, WORDS[s][:13]), s) for s in WORDS for _ in range(60)]
    documents, truth = [(0, None), (1, ""), (2, " \n"), (3, "12 345"), (4, "The meeting was moved to another day.")], set()
    for i in range(10, 900):
        about = rng.choices([*WORDS, None], k=rng.choice([1, 1, 2, 5]))
        some = [rng.choice(about) for _ in range(rng.randint(1, 9))]
        documents.append((i, " ".join(sentence(rng, s) for s in some)))
        truth |= {(i, s) for s in WORDS if some.count(s) and some.count(s) >= 0.25 * len(some)}
    return documents, examples, truth


def test_subjects_of_made_texts(spark, made):
    documents, examples, truth = made
    df = spark.createDataFrame([(*r, "x", 1) for r in documents], "doc_id bigint, text string, subject string, item int")
    ex = spark.createDataFrame([(*r, "x") for r in examples] + [("no subject", None, "x"), (None, "red", "x")], "text string, subject string, item string")
    got = {tuple(r) for r in assign_subjects(df, "doc_id", "text", ex, "text", "subject").collect()}
    assert len(got & truth) / len(got) > 0.98 and len(got & truth) / len(truth) > 0.98
    assert not {d for d, _ in got} & {0, 1, 2, 3, 4}
    twice = df.unionByName(df)
    assert assign_subjects(twice, "doc_id", "text", ex, "text", "subject").groupBy("doc_id", "subject").count().filter("count > 1").count() == 0


def test_terms_beyond_the_broadcast_size(spark, made):
    documents, examples, truth = made
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    ex = spark.createDataFrame(examples, "text string, subject string")
    whole = {tuple(r) for r in assign_subjects(df, "doc_id", "text", ex, "text", "subject").collect()}
    for size in (7, 40):
        assert {tuple(r) for r in assign_subjects(df, "doc_id", "text", ex, "text", "subject", settings=TopicSettings(vocabulary=size)).collect()} == whole


def test_examples_keep_their_partitions(spark, made, monkeypatch):
    from strandframe.llm import subjects

    tasks = []
    monkeypatch.setattr(subjects, "cut", lambda df, cut=subjects.cut: tasks.append(df.rdd.getNumPartitions()) or cut(df))
    df = spark.createDataFrame(made[0], "doc_id bigint, text string").repartition(2)
    ex = spark.createDataFrame(made[1], "text string, subject string").repartition(3)
    assert assign_subjects(df, "doc_id", "text", ex, "text", "subject").count()
    assert tasks[0] == 5


def test_empty_tables(spark, made):
    df = spark.createDataFrame([(1, "The redba was near.")], "doc_id bigint, text string")
    ex = spark.createDataFrame(made[1], "text string, subject string")
    assert assign_subjects(df.limit(0), "doc_id", "text", ex, "text", "subject").count() == 0
    assert assign_subjects(df, "doc_id", "text", ex.limit(0), "text", "subject").count() == 0


def test_sentences_and_digamma(spark):
    text = 'One, two. "Three!" <b>Four</b> &amp; five ? Six\nseven... 12. « Huit ! » Neuf'
    row = spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s")).first()
    assert len(row.s) == 6
    x = np.array([0.05, 0.3, 1.0, 10.0])
    assert np.allclose(np.log(exp_digamma(x)), [-20.497845, -3.502524, -0.577216, 2.251753], rtol=2e-3, atol=2e-3)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_examples(spark):
    d = "/root/testdata/sf0.01"
    ex = spark.read.parquet(f"{d}/subject_examples.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    held = ex.filter("example_id % 4 = 0").select((F.col("example_id") + 10**9).alias("doc_id"), "text", "subject")
    found = assign_subjects(docs.unionByName(held.select("doc_id", "text")), "doc_id", "text", ex.filter("example_id % 4 <> 0"), "text", "subject")
    got = {tuple(r) for r in found.filter("doc_id > 1000000000").collect()}
    want = {tuple(r) for r in held.select("doc_id", "subject").collect()}
    assert len(got & want) >= 0.97 * max(len(got), len(want))


def test_naming_can_fail():
    counts = np.array([[5.0, 0, 4, 0], [4, 0, 4, 0], [0, 9, 0, 0], [0, 0, 0, 6]])
    examples = np.array([[3.0, 0], [2, 1], [0, 4], [0, 0]])
    assert name_topics(counts[:, :2], examples, 2).tolist() == [0, 1]
    # A topic of both subjects, and one of words that the examples lack.
    mixed = np.array([[5.0, 0], [0, 0], [5, 0], [0, 6]])
    assert name_topics(mixed, examples, 3).tolist() == [-1, -1]
    assert name_topics(mixed, examples, 3, mixed.sum(axis=0), np.array([1, 1])).tolist() == [-1, 1]


def test_clusters_follow_words():
    rng = random.Random(2)
    texts = [rng.sample(WORDS[s], 4) for s in WORDS for _ in range(30)] + [[], ["alone"]]
    found = clusters(texts, 12, 3)
    for k in set(found[:120]):
        assert len({i // 30 for i in np.flatnonzero(found[:120] == k)}) == 1
