import random

import numpy as np
import pytest

from strandframe.llm import shared_spans as m


def brute(rows, n):
    owners = {}
    for rid, text in rows:
        s = (text or "").upper()
        for i in range(len(s) - n + 1):
            if set(s[i : i + n]) <= set("ACGT"):
                owners.setdefault(s[i : i + n], set()).add(rid)
    hit = {}
    for rid, text in rows:
        s = (text or "").upper()
        for i in range(len(s) - n + 1):
            if len(owners.get(s[i : i + n], ())) > 1 and rid is not None:
                hit.setdefault(rid, set()).update(range(i, i + n))
    out = []
    for rid, places in hit.items():
        start = None
        for p in sorted(places):
            if start is None or p != end:
                if start is not None:
                    out.append((rid, start, end))
                start = p
            end = p + 1
        out.append((rid, start, end))
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    blocks = [dna(rng.randint(60, 200)) for _ in range(6)] + ["A" * 90, "AC" * 50]
    out = [(None, blocks[0]), (1, None), (2, ""), (3, "ACGT"), (4, "é" * 3 + blocks[0] + "\n" + blocks[1])]
    for i in range(5, 60):
        s = ""
        for _ in range(rng.randint(1, 6)):
            b = rng.choice(blocks)
            a, z = sorted(rng.sample(range(len(b) + 1), 2))
            s += rng.choice([dna(rng.randint(0, 80)), "N" * rng.randint(1, 4), b, b[a:z], b.lower(), b[: len(b) // 2] + "R" + b[len(b) // 2 :]])
        out.append((i, s))
    # One stretch in a third of all records, between different neighbours.
    out += [(100 + i, dna(40) + blocks[2] + dna(40)) for i in range(30)]
    return out + [(7, out[7][1])]


@pytest.mark.parametrize("seed,shard,n", [(1, 1 << 18, 64), (2, 2000, 64), (3, 1000, 50), (4, 2000, 100), (5, 2000, 20), (6, 500, 24), (7, 250, 64)])
def test_against_brute_force(spark, monkeypatch, seed, shard, n):
    monkeypatch.setattr(m, "TILE", 128)
    data = [r for r in rows(seed) if r[0] is not None]
    df = spark.createDataFrame([(*r, 1, "x") for r in data] + [(None, "ACGT" * 40, 1, "x")], "ref_id bigint, t string, code int, text string")
    got = m.shared_spans(df, "ref_id", "t", n, shard=shard).collect()
    assert sorted(map(tuple, got)) == brute(data, n)


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("ACGT") for _ in range(3 * m.CHUNK // 2))
    a, b = m.CHUNK - 100, m.CHUNK + 300
    data = [(1, long), (2, long[a:b]), (3, "N" + long[:70] + "N")]
    got = m.shared_spans(spark.createDataFrame(data, "r bigint, t string"), "r", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 70), (1, a, b), (2, 0, b - a), (3, 1, 71)]


def test_empty_table_and_limits(spark):
    df = spark.createDataFrame([], "r bigint, t string")
    assert m.shared_spans(df, "r", "t").count() == 0
    with pytest.raises(ValueError):
        m.shared_spans(df, "r", "t", 0)


def test_single_letters(spark):
    df = spark.createDataFrame([(1, "ANNC"), (2, "GGAG"), (3, "T")], "r bigint, t string")
    assert sorted(map(tuple, m.shared_spans(df, "r", "t", 1).collect())) == [(1, 0, 1), (2, 2, 3)]


def test_automaton_against_search():
    rng = random.Random(5)
    words = ["".join(rng.choice("AC") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    lanes = sorted(words + ["".join(rng.choice("ACG") for _ in range(40)) for _ in range(8)], key=len, reverse=True)
    auto = m.Automaton()
    for i, w in enumerate(words):
        auto.add(m._CODE[np.frombuffer(w.encode(), np.uint8)].tobytes(), i % 5, i % 5 + i % 2)
    auto.close()
    owner = np.array([rng.randrange(6) for _ in lanes])
    length = np.array([len(x) for x in lanes])
    got = auto.spans(m._CODE[np.frombuffer("".join(lanes).encode(), np.uint8)], np.cumsum(length) - length, length, owner, 4)
    got = sorted(zip(*[x.tolist() for x in got]))
    want = []
    for k, lane in enumerate(lanes):
        marked = set()
        for a in range(len(lane) - 3):
            if any(lane[a : a + 4] in w and {i % 5, i % 5 + i % 2} - {owner[k]} for i, w in enumerate(words)):
                marked |= {(a, a + 4)}
        runs = []
        for a, b in sorted(marked):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        want += [(k, a, b) for a, b in runs]
    assert got == sorted(want)
