import random
import re

from strandframe.llm.splitting import split_oversized


def natural(seq, step):
    return max(len(x) for x in re.split(r"[Nn]{10,}", seq)) <= step


def texts():
    rng = random.Random(5)
    out = [None, "", "A" * 20, "A" * 21, "N" * 500, "ACGT" * 30 + "n" * 10 + "ACG" * 4, "é\n" * 40, "A" * 5000]
    for _ in range(300):
        s = ""
        while len(s) < rng.randint(5, 120):
            s += rng.choice("ACGT") * rng.randint(1, 17) if rng.random() < 0.6 else rng.choice("Nn") * rng.randint(1, 25)
        out.append(s)
    return out + out[-3:]


def test_pieces(spark):
    limit, overlap = 20, 4
    rows = [(i, x, 1) for i, x in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, text string, pieces int")
    got = {r.id: r for r in split_oversized(df, "text", limit, overlap, keep=["id"]).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        if text is None:
            assert r.pieces is None and r.cut is None
            continue
        if not text:
            assert r.pieces == [] and r.cut is None
            continue
        if len(text) <= limit:
            assert r.cut is None and [p.piece for p in r.pieces] == [text]
            continue
        at = 0
        for k, p in enumerate(r.pieces):
            assert p.piece == text[p.start : p.end] and len(p.piece) <= limit
            assert p.start == max(0, at - overlap) if k else p.start == 0
            assert p.end > at
            at = p.end
        assert at == len(text)
        assert r.cut == ("natural" if natural(text, limit - overlap) else "forced"), text


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert split_oversized(df, "text", 10, 2, keep=["id"]).count() == 0


def test_item_of_many_pieces(spark):
    df = spark.range(1).selectExpr("repeat('ACGTTGCA', 1500) t")
    pieces = split_oversized(df, "t", 12, 4).first().pieces
    text = "ACGTTGCA" * 1500
    assert [(p.start, p.end) for p in pieces[:2]] == [(0, 8), (4, 16)] and len(pieces) == 1500
    assert all(p.piece == text[p.start : p.end] for p in pieces) and pieces[-1].end == len(text)
