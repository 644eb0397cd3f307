import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.config import BASE_HASH, CONFIG, MULTIPLIER, MapperConfig
from strandframe.functions import sequences as S
from strandframe.operators import index as I
from strandframe.operators import multipass as M
from strandframe.operators.extension import extend, reference_tiles
from strandframe.operators.pairing import first_alignments, pair_candidates, resolve_pairs
from strandframe.operators.sam import sam_header, sam_lines, sam_rows, write_sam
from strandframe.operators.seeding import probes, seed_hits, top_candidates
from strandframe.operators.syncmers import CHUNK, CODES, explode_syncmers, syncmers_of
from strandframe.plans.map_reads import align, map_reads, map_reads_in_passes
from strandframe.plans.simulate import simulated_pairs

MASK = 2**64 - 1
rotl = lambda x, n: ((x << (n % 64)) | (x >> (64 - n % 64))) & MASK if n % 64 else x


def test_hash_constants_are_the_bits_of_their_doubles():
    bits = [struct.unpack("<Q", struct.pack("<d", x))[0] for x in (math.e - 2, math.pi - 3, math.sqrt(2) - 1, 1.7320508075688772 - 1, 1.618033988749)]
    assert [*BASE_HASH, MULTIPLIER] == bits


def literal_hash(word):
    h = 0
    for c in word:
        h = rotl(h, 1) ^ BASE_HASH["ACGT".index(c)]
    return h * MULTIPLIER & MASK


def literal_syncmers(seq):
    out = []
    seq = seq.upper()
    for p in range(len(seq) - 20):
        k = seq[p : p + 21]
        if set(k) - set("ACGT"):
            continue
        hashes = [literal_hash(k[i : i + 6]) for i in range(16)]
        at = max(i for i in range(16) if hashes[i] == min(hashes))
        if at in (0, 15):
            out.append((literal_hash(k) >> 20, p))
    return out


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def revcomp(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(s.upper()))


def test_syncmers_on_both_strands(spark):
    rng = random.Random(3)
    seqs = [None, "", "A" * 20, "A" * 21, "A" * 60, "AC" * 40, dna(rng, 22), dna(rng, 300).lower(), dna(rng, 50) + "N" + dna(rng, 80), dna(rng, 40) + "é" + dna(rng, 40), "N" * 50]
    seqs += [dna(rng, rng.randint(15, 200)) for _ in range(30)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)], "id int, s string, is_rev string")
    got = {(r.id, r.is_rev, r.key44, r.pos) for r in explode_syncmers(df, ["id"], "s", both_strands=True).collect()}
    want = {(i, rev, *x) for i, s in enumerate(seqs) if s for rev in (False, True) for x in literal_syncmers(revcomp(s) if rev else s)}
    assert got == want
    one = {(r.id, r.key44, r.pos) for r in explode_syncmers(df, ["id"], "s").collect()}
    assert one == {(i, k, p) for i, rev, k, p in want if not rev}
    assert explode_syncmers(df.limit(0), ["id"], "s").count() == 0


def test_syncmers_of_long_sequence_in_parts(spark):
    codes = np.random.default_rng(1).integers(0, 4, CHUNK + 5000).astype(np.uint8)
    at, h = syncmers_of(codes)
    seq = "".join(np.array(list("ACGT"))[codes])
    rows = explode_syncmers(spark.createDataFrame([(1, seq)], "id int, s string"), ["id"], "s").select("key44", "pos").collect()
    assert sorted((r.pos, r.key44) for r in rows) == [(int(p), int(x >> np.uint64(20))) for p, x in zip(at, h)]


def literal_extend(read, ref, anchor, diag):
    """The walk, base by base."""
    norm = lambda c: "a" if c in "Nn" else c.lower()
    eq = lambda x, y: norm(x) == norm(y)

    def side(step, rp, gp):
        right = step == 1
        at = lambda s, i: s[i] if right else s[i - 1]
        more = lambda s, i: len(s) - i if right else i

        def peek(r, g):
            n = 0
            for _ in range(4):
                if more(read, r) < 1 or more(ref, g) < 1:
                    break
                n += eq(at(read, r), at(ref, g))
                r, g = r + step, g + step
            return n

        score = top = nm = run = 0
        cigar, best = [], (rp, gp, 0, 0, 0)
        while more(read, rp) > 0 and more(ref, gp) > 0:
            if eq(at(read, rp), at(ref, gp)):
                score, run, rp, gp = score + 2, run + 1, rp + step, gp + step
            else:
                if run:
                    cigar.append((run, "M"))
                    run = 0
                sub, dele, ins = peek(rp + step, gp + step), peek(rp, gp + step), peek(rp + step, gp)
                if sub >= dele and sub >= ins:
                    cigar.append((1, "M"))
                    rp, gp = rp + step, gp + step
                elif dele >= ins and (right or gp > 1):
                    cigar.append((1, "D"))
                    gp += step
                elif right or rp > 1:
                    cigar.append((1, "I"))
                    rp += step
                else:
                    break
                score, nm = score - 2, nm + 1
            if score > top:
                top, best = score, (rp, gp, len(cigar), run, nm)
            if score < top - 15:
                break
        rp, gp, n, run, nm = best
        return top, rp, gp, cigar[:n] + ([(run, "M")] if run else []), nm

    start = min(diag + anchor, len(ref) - 1) if diag >= 0 else max(anchor + diag, 0)
    ls, lr, lg, lc, ln = side(-1, anchor, start)
    rs, rr, _, rc, rn = side(1, anchor, start)
    cigar = []
    for n, op in [(lr, "S"), *reversed(lc), *rc, (len(read) - rr, "S")]:
        if n and cigar and cigar[-1][1] == op:
            cigar[-1] = (cigar[-1][0] + n, op)
        elif n:
            cigar.append((n, op))
    return lg, ls + rs, ln + rn, rr - lr, cigar


def test_extension_against_literal_walk():
    rng = random.Random(8)
    for _ in range(1500):
        ref = dna(rng, rng.randint(25, 200))
        a = rng.randrange(len(ref) - 20)
        read = list(ref[a : a + rng.randint(20, 120)])
        for _ in range(rng.randint(0, 8)):
            p = rng.randrange(len(read))
            read[p : p + 1] = rng.choice([[rng.choice("ACGTNn")], [], [read[p], rng.choice("ACGT")], list(dna(rng, 3))])
            if not read:
                read = ["A"]
        read = dna(rng, rng.choice([0, 0, 5])) + "".join(read)
        anchor = rng.randrange(len(read))
        pos = min(len(ref) - 1, max(0, a + anchor + rng.randint(-2, 2)))
        assert extend(read.encode(), ref.encode(), anchor, pos - anchor) == literal_extend(read, ref, anchor, pos - anchor)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    seqs = [dna(rng, n) for n in (3000, 1500, 700, 400)]
    seqs.append(seqs[0][1000:1800])  # a copy, so that some reads have two places
    refs = [(i + 1, f"ref{i + 1}", s, "x") for i, s in enumerate(seqs)] + [(9, "empty", None, "x")]
    return spark.createDataFrame(refs, "ref_id bigint, ref_name string, seq string, pos string").cache()


def test_simulated_reads_come_back(spark, world):
    reads = simulated_pairs(world).cache()
    rows = map_reads(reads, I.build_index(world), world).cache()
    assert rows.count() == 2 * reads.count()
    assert rows.filter("flag & 4 = 0").count() > 0.98 * rows.count()
    t = rows.select("*", S.truth_of(F.col("qname")).alias("t")).filter("mapq >= 30")
    right = t.filter("rname = t.ref and abs(pos - if(flag & 64 > 0, t.pos1, t.pos2)) <= 10").count()
    assert t.count() > 20 and right >= 0.97 * t.count()
    assert rows.filter("flag & 2 > 0 and abs(tlen) <> 300").count() < 0.1 * rows.count()


def test_edges_of_reads_and_references(spark, world):
    seq = world.filter("ref_id = 1").first().seq
    cases = {
        "start": seq[:100], "end": seq[-100:], "n": seq[200:260] + "N" * 5 + seq[265:330], "lower": seq[400:500].lower(), "rev": revcomp(seq[500:620]),
        "del": seq[700:760] + seq[761:840], "ins": seq[900:950] + revcomp(seq[950]) + seq[950:1000], "short": seq[:20], "random": "ACGTTGCA" * 15, "empty": "", "null": None,
    }
    rows = [(i, n, s, "I" * len(s or "") or None, None, None, "x") for i, (n, s) in enumerate(cases.items())]
    reads = spark.createDataFrame(rows, "read_id bigint, name string, seq1 string, qual1 string, seq2 string, qual2 string, tlen string")
    got = {r.qname: r for r in map_reads(reads, I.build_index(world), world).collect()}
    assert set(got) == set(cases) - {"empty", "null"}
    place = lambda n: (got[n].rname, got[n].pos, got[n].flag)
    assert place("start") == ("ref1", 1, 0) and place("end") == ("ref1", len(seq) - 99, 0)
    assert place("n") == ("ref1", 201, 0) and place("lower") == ("ref1", 401, 0)
    assert place("rev") == ("ref1", 501, 16) and got["rev"].seq == seq[500:620]
    assert "D" in got["del"].cigar and "I" in got["ins"].cigar
    assert got["short"].flag == got["random"].flag == 4 and got["short"].cigar == "*"
    assert map_reads(reads.limit(0), I.build_index(world), world).count() == 0
    assert map_reads(reads, I.build_index(world.limit(0)), world.limit(0)).filter("flag <> 4").count() == 0


def test_limits_of_probes_and_reads(spark):
    rng = random.Random(2)
    unit = dna(rng, 120)
    refs = spark.createDataFrame([(i, unit + dna(rng, 5)) for i in range(30)], "ref_id bigint, seq string")
    reads = spark.createDataFrame([(1, unit, None)], "read_id bigint, seq1 string, seq2 string")
    cfg = MapperConfig(most_per_probe=4, most_per_read=17)
    hits = seed_hits(probes(reads, cfg), I.build_index(refs, cfg=cfg), cfg)
    assert hits.count() == 17 and hits.filter("full").count() == 17
    assert hits.groupBy("qpos", "is_rev").count().agg(F.max("count")).first()[0] == 4
    assert {r.mapq for r in top_candidates(hits, cfg).collect()} == {0}
    assert I.build_index(refs, cfg=MapperConfig(most_per_remainder=29)).filter("pos < 100").count() == 0


def test_index_round_trip(spark, world, tmp_path):
    index = I.build_index(world)
    for table in (index, index.limit(0)):
        I.write_index(table, str(tmp_path / "index"))
        back = I.read_index(spark, str(tmp_path / "index"))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_pairs(spark):
    a = lambda read, mate, rank, ref, pos, rev, score: (read, mate, rank, ref, pos, rev, 5, [(50, "M")], 0, score)
    rows = [
        a(1, 1, 1, 1, 100, False, 90), a(1, 2, 1, 1, 300, True, 90),
        a(2, 1, 1, 1, 100, False, 90), a(2, 1, 2, 1, 150, False, 80), a(2, 2, 1, 1, 300, True, 90),
        a(3, 1, 1, 1, 100, False, 90), a(3, 2, 1, 2, 300, True, 90),
        a(4, 1, 1, 1, 5000, True, 90), a(4, 2, 1, 1, 100, False, 90),
        a(5, 2, 1, 1, 100, False, 90),
        a(6, 1, 1, 1, 900, True, 90), a(6, 2, 1, 1, 100, False, 60), a(6, 2, 2, 1, 200, False, 60),
    ]
    kind = "read_id bigint, mate int, rank int, ref_id bigint, pos int, is_rev boolean, mapq int, cigar array<struct<len:int,op:string>>, nm int, as_score int"
    df = spark.createDataFrame(rows, kind)
    got = {r.read_id: r for r in resolve_pairs(df).collect()}
    assert (got[1].r1.mapq, got[1].proper, got[1].tlen) == (60, True, 250)
    assert (got[2].r1.mapq, got[2].r1.rank) == (20, 1)
    assert (got[3].r1.mapq, got[3].proper, got[3].tlen) == (5, False, 0)
    assert (got[4].proper, got[4].tlen) == (False, -4950)
    assert got[5].r1 is None and got[5].r2.pos == 100 and got[5].tlen == 0
    assert (got[6].r2.rank, got[6].r2.mapq, got[6].tlen) == (1, 0, -850)
    assert pair_candidates(df).count() == 5
    assert {r.tlen for r in first_alignments(df).collect()} == {0}
    assert resolve_pairs(df.limit(0)).count() == 0


def test_sam_text_and_files(spark, world, tmp_path):
    reads = simulated_pairs(world).limit(20).cache()
    rows = map_reads(reads, I.build_index(world), world, sort=True).cache()
    line = sam_lines(rows.filter("flag & 4 = 0")).first().value.split("\t")
    assert len(line) == 14 and line[11].startswith("NM:i:") and line[13] == "RG:Z:sf"
    write_sam(rows, world, str(tmp_path / "sam"), sort=True)
    head = [r.value for r in spark.read.text(str(tmp_path / "sam/header")).collect()]
    assert head[0].endswith("SO:coordinate") and sum(h.startswith("@SQ") for h in head) == 5
    from strandframe.sources.fastx import read_sam

    back = read_sam(spark, str(tmp_path / "sam/body"))
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nm", "as_score"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, rows.select(cols).collect()))
    with pytest.raises(ValueError):
        sam_rows(reads, first_alignments(align(reads, I.build_index(world), world)), world, style="bam")
    with pytest.raises(ValueError):
        sam_header(world, "name")


def test_passes(spark, world):
    plan = {r.ref_id: r.ref_pass for r in M.reference_passes(world, 2000).collect()}
    assert plan == {1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 9: 3}
    reads = simulated_pairs(world).limit(15).cache()
    rows = map_reads_in_passes(reads, world, 2500)
    assert rows.count() == 2 * reads.count()
    assert rows.filter("flag & 4 = 0").count() >= 0.95 * 2 * reads.count()
    found = M.map_in_passes(reads, world, 2500, lambda r, refs: align(r, I.build_index(refs), refs))
    assert found.groupBy("read_id", "mate").agg(F.countDistinct("ref_pass").alias("n")).filter("n > 1").count() == 0


def test_column_functions(spark):
    rows = [("a", "ACGTN", True, "x/1 more", "r1_10_20_0_1_0:0:0_7/1"), ("b", "acgt-", False, None, "plain"), ("c", None, None, " ", "a_b_1_2_1_0_z")]
    df = spark.createDataFrame(rows, "k string, s string, rev boolean, name string, q string")
    seq, qual = S.oriented(F.col("s"), F.col("k"), F.col("rev"))
    got = {r.k: r for r in df.select("k", seq.alias("o"), S.reverse_complement_upper(F.col("s")).alias("u"), S.read_name(F.col("name")).alias("n"), S.truth_of(F.col("q")).alias("t"), S.reference_name(F.col("name"), F.lit(4)).alias("r")).collect()}
    assert got["a"].o == "NACGT" and got["b"].o == "acgt-" and got["b"].u == "NACGT"
    assert got["a"].n == "x" and got["b"].n is None and got["a"].r == "x/1" and got["b"].r == got["c"].r == "ref_4"
    assert tuple(got["a"].t) == ("r1_10_20_0_1_0:0:0_7", "r1", 10, 20) and got["b"].t is None and got["c"].t.ref == "a_b"
    tags = spark.createDataFrame([(["NM:i:3", "AS:i:-4"],), ([],)], "t array<string>").select(S.tag_value(F.col("t"), "AS").alias("v")).collect()
    assert {r.v for r in tags} == {-4, None}


def test_session_over_batches(spark, world, tmp_path):
    from strandframe.operators.evaluation import append_metrics, run_summary
    from strandframe.plans.map_reads import MappingSession

    reads = simulated_pairs(world).limit(12).cache()
    session = MappingSession(world, str(tmp_path / "session"))
    session.map_to(reads.filter("read_id % 2 = 0"), str(tmp_path / "out"))
    totals = session.map_to(reads.filter("read_id % 2 = 1"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert totals["reads"] == rows.count() == 2 * reads.count()
    summary = run_summary(rows, world)
    assert summary.first().mapped == totals["mapped"] and summary.first().mapped_bases == totals["mapped_bases"]
    for _ in range(2):
        append_metrics(summary, str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).count() == 2
    assert run_summary(rows.limit(0), world.limit(0)).first().mean_coverage == 0


def test_index_ranks_are_written(spark, world, tmp_path):
    index = I.build_index(world)
    I.write_index(index, str(tmp_path / "index"))
    back = I.read_index(spark, str(tmp_path / "index"), ranks=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, I.ranked(index).collect()))
    assert I.ranked(back) is back


def test_tiles_of_references(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "TT"), (3, ""), (4, None)], "ref_id bigint, seq string")
    got = sorted(map(tuple, reference_tiles(refs, 4, 3).collect()))
    assert got == [(1, 0, 10, "ACGTACG"), (1, 1, 10, "ACGTAC"), (1, 2, 10, "AC"), (2, 0, 2, "TT")]


def test_extension_does_not_depend_on_tiles(spark, monkeypatch):
    from strandframe.operators import extension

    rng = random.Random(21)
    long = dna(rng, 30_000)
    at = list(range(0, 29_800, 100))
    reads = spark.createDataFrame([(i, long[p : p + 150], None) for i, p in enumerate(at)], "read_id bigint, seq1 string, seq2 string")
    refs = spark.createDataFrame([(7, long)], "ref_id bigint, seq string")
    found = [(i, 1, 1, 7, False, p, 20, 3, 60) for i, p in enumerate(at)]
    kinds = "read_id bigint, mate int, vote_rank int, ref_id bigint, is_rev boolean, diag int, votes bigint, anchor int, mapq int"
    candidates = spark.createDataFrame(found, kinds)
    for size in (1 << 14, 1):
        monkeypatch.setattr(extension, "TILE", size)
        rows = extension.extend_candidates(candidates, reads, refs).collect()
        assert sorted((r.read_id, r.pos, r.as_score) for r in rows) == [(i, p, 300) for i, p in enumerate(at)]
