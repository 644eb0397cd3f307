import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import evaluation as E
from strandframe.operators.index import build_index
from strandframe.plans.simulate import simulated_pairs
from strandframe.sources import fastx as X


def put(path, text, packed=False):
    (gzip.open if packed else open)(path, "wt").write(text)
    return str(path)


def test_fasta_and_fastq(spark, tmp_path):
    put(tmp_path / "a.fa", ">one first\nACGT\nacgt\n>two\n\n>three\nN\n")
    put(tmp_path / "b.fa.gz", ">four x\nGG\r\nTT\r\n", packed=True)
    refs = X.read_references(spark, str(tmp_path / "*.fa*")).orderBy("ref_id").collect()
    assert [(r.ref_name, r.seq) for r in refs] == [("one", "ACGTacgt"), ("two", ""), ("three", "N"), ("four", "GGTT")]
    put(tmp_path / "r_1.fq", "@p/1 z\nAC\n+\nII\n@q/1\nGG\n+\n@@\n")
    put(tmp_path / "r_2.fq", "@p/2\nTT\n+\nFF\n@q/2\nCC\n+\n##\n")
    pairs = X.read_pairs(spark, str(tmp_path / "r_1.fq"), str(tmp_path / "r_2.fq")).orderBy("read_id").collect()
    assert [(r.name, r.seq1, r.qual1, r.seq2, r.qual2) for r in pairs] == [("p", "AC", "II", "TT", "FF"), ("q", "GG", "@@", "CC", "##")]
    single = X.read_single(spark, str(tmp_path / "r_1.fq")).collect()
    assert {(r.name, r.seq2) for r in single} == {("p", None), ("q", None)}
    put(tmp_path / "s_2.fq", "@p/2\nTT\n+\nFF\n")
    with pytest.raises(Exception, match="different numbers"):
        X.read_pairs(spark, str(tmp_path / "r_1.fq"), str(tmp_path / "s_2.fq")).collect()
    assert X.read_pairs(spark, str(tmp_path / "r_1.fq"), str(tmp_path / "s_2.fq"), "truncate").count() == 1
    put(tmp_path / "broken.fq", "@p\nACG\n+\nII\n")
    with pytest.raises(Exception, match="broken record"):
        X.read_single(spark, str(tmp_path / "broken.fq")).collect()
    put(tmp_path / "none.fq", "")
    assert X.read_single(spark, str(tmp_path / "none.fq")).count() == 0


def test_small_tables(spark, tmp_path):
    assert X.read_truth(spark, put(tmp_path / "t.tsv", "r\tchr\t5\n")).first().pos == 5
    assert {r.key for r in X.read_keys(spark, put(tmp_path / "k.txt", "1:2:A:T\n\n1:2:A:T\n3:4:C:G\n")).collect()} == {"1:2:A:T", "3:4:C:G"}
    files = spark.createDataFrame([("d/s1_1.fq.gz",), ("d/s1_2.fq.gz",), ("d/s2_1.fq.gz",), ("d/other",), (None,)], "path string")
    assert [tuple(r) for r in X.sample_pairs(files).collect()] == [("s1", "d/s1_1.fq.gz", "d/s1_2.fq.gz")]


def test_stream_of_read_files(spark, tmp_path):
    from strandframe.streaming.mapping import map_stream, totals

    rng = random.Random(1)
    refs = spark.createDataFrame([(1, "r1", "".join(rng.choice("ACGT") for _ in range(3000)))], "ref_id bigint, ref_name string, seq string").cache()
    reads = simulated_pairs(refs).cache()
    half = F.col("read_id") % 2
    reads.filter(half == 0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = build_index(refs).cache()
    go = lambda: map_stream(spark, str(tmp_path / "in"), index, refs, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    go()
    first = totals(spark, str(tmp_path / "out")).agg(F.sum("reads")).first()[0]
    reads.filter(half == 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    after = totals(spark, str(tmp_path / "out")).agg(F.sum("reads"), F.sum("mapped")).first()
    assert first == 2 * reads.filter(half == 0).count() and after[0] == 2 * reads.count() and after[1] >= 0.95 * after[0]


def test_sets_and_metrics(spark):
    sets = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "a"), ("k2", "a"), ("k3", "c"), ("", "a"), (None, "b")], "key string, caller string")
    got = {r.region: r.n for r in E.set_regions(sets, "key", "caller", ["a", "b", "c"]).collect()}
    assert got == {"a": 1, "b": 0, "c": 1, "a&b": 1, "a&c": 0, "b&c": 0, "a&b&c": 0}
    empty = E.variant_accuracy(sets.limit(0), sets.limit(0), "key").first()
    assert (empty.tp, empty.precision, empty.f1) == (0, 0.0, 0.0)
    sam = spark.createDataFrame([("t", "r_5_9_0_1_x", 65, "r", 5, 9, 1), ("t", "r_5_9_0_1_x", 65, "r", 900, 9, 2)], "tool string, qname string, flag int, rname string, pos bigint, mapq int, row_no bigint")
    row = E.accuracy(E.judged(E.truth_from_names(sam), E.tool_results(sam))).first()
    assert (row.tp, row.fp, row.fn) == (0, 1, 1)
    assert E.first_errors(E.judged(E.truth_from_names(sam), E.tool_results(sam))).first().error == "Dist 895"


def test_command_line_and_bam(spark, tmp_path):
    import struct
    import zlib

    from strandframe.__main__ import main

    rng = random.Random(6)
    seqs = {f"r{i}": "".join(rng.choice("ACGT") for _ in range(900)) for i in range(3)}
    put(tmp_path / "ref.fa", "".join(f">{n} x\n{s[:500]}\n{s[500:]}\n" for n, s in seqs.items()))
    refs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs.items())], "ref_id bigint, ref_name string, seq string")
    reads = simulated_pairs(refs).collect()
    for m in (1, 2):
        put(tmp_path / f"a_{m}.fq", "".join(f"@{r.name}/{m}\n{r[f'seq{m}']}\n+\n{r[f'qual{m}']}\n" for r in reads))
    main(["build", str(tmp_path / "ref.fa"), str(tmp_path / "index")], spark)
    both = ["-1", str(tmp_path / "a_1.fq"), "-2", str(tmp_path / "a_2.fq")]
    main(["map", str(tmp_path / "index"), *both, "-o", str(tmp_path / "sam")], spark)
    sam = X.read_sam(spark, str(tmp_path / "sam/body")).collect()
    assert len(sam) == 2 * len(reads) and sum(r.flag & 4 == 0 for r in sam) >= 0.95 * len(sam)
    main(["map", str(tmp_path / "index"), *both, "-o", str(tmp_path / "bam"), "--format", "BAM", "--sort"], spark)
    found = []
    for path in sorted((tmp_path / "bam").iterdir()):
        data = path.read_bytes()
        plain = gzip.decompress(data)
        assert data.endswith(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
        at = 8 + struct.unpack_from("<i", plain, 4)[0]
        names = []
        n = struct.unpack_from("<i", plain, at)[0]
        at += 4
        for _ in range(n):
            size = struct.unpack_from("<i", plain, at)[0]
            names.append(plain[at + 4 : at + 3 + size].decode())
            at += 8 + size
        assert names == list(seqs)
        while at < len(plain):
            size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mpos, tlen = struct.unpack_from("<iiiBBHHHiiii", plain, at)
            start = at + 36
            name = plain[start : start + l_name - 1].decode()
            cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", plain, start + l_name)) or "*"
            packed = plain[start + l_name + 4 * n_cigar :][: (l_seq + 1) // 2]
            seq = "".join("=ACMGRSVTWYHKDBN"[x] for b in packed for x in (b >> 4, b & 15))[:l_seq]
            found.append((name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, tlen, seq))
            at += 4 + size
    assert sorted(found) == sorted((r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.tlen, r.seq) for r in sam)
    assert zlib.crc32(b"") == 0
    with pytest.raises(SystemExit):
        main(["map", str(tmp_path / "index"), *both, "-1", "x", "-o", "y"], spark)


def test_sql_functions(spark):
    from strandframe.functions.registration import register_functions
    from strandframe.operators.syncmers import explode_syncmers

    register_functions(spark)
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(300))
    df = spark.createDataFrame([(1, seq), (2, None), (3, "ACG")], "id int, seq string")
    df.createOrReplaceTempView("some")
    got = spark.sql("select id, key44, pos from some, lateral syncmers(seq)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, explode_syncmers(df, ["id"], "seq").collect()))
    assert tuple(spark.sql("select reverse_complement('ACgtR'), cigar_span('3S10M2I4D')").first()) == ("NacGT", 14)


def test_ranges_of_plain_files(spark, tmp_path):
    rng = random.Random(8)
    quality = lambda n: "".join(rng.choice("@+I>") for _ in range(n))
    want = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    put(tmp_path / "a.fq", "".join(f"@{n} x\n{s}\n+\n{quality(len(s))}\n" for n, s in want))
    put(tmp_path / "b.fa", "".join(f">{n}\n{s[:3]}\n{s[3:]}\n" for n, s in want))
    X.register(spark)
    for name in ("a.fq", "b.fa"):
        for split in (7, 64, 1 << 20):
            rows = spark.read.format("fastx").option("path", str(tmp_path / name)).option("split", split).load()
            assert [(r.name, r.seq) for r in rows.orderBy("place").collect()] == want
            assert split > 64 or rows.rdd.getNumPartitions() > 20
    with gzip.open(tmp_path / "c.fq.gz", "wt") as out:
        out.write((tmp_path / "a.fq").read_text())
    rows = spark.read.format("fastx").option("path", f"file://{tmp_path}/c.fq.gz").option("split", 7).load()
    assert rows.rdd.getNumPartitions() == 1 and [(r.name, r.seq) for r in rows.orderBy("place").collect()] == want


def test_stream_of_fastq_files(spark, tmp_path):
    from strandframe.streaming.mapping import map_fastq_stream, totals

    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    refs = spark.createDataFrame([(1, "chr", ref)], "ref_id bigint, ref_name string, seq string")
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        at = [rng.randrange(2600) for _ in range(10)]
        for m in (2, 1):
            texts = [ref[p : p + 100] if m == 1 else turned(ref[p + 200 : p + 300]) for p in at]
            put(tmp_path / "in" / f"s{k}_{m}.fq", "".join(f"@r{i}_{k}/{m}\n{t}\n+\n{'I' * 100}\n" for i, t in enumerate(texts)))
        query = map_fastq_stream(spark, str(tmp_path / "in"), build_index(refs), refs, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        assert [(r.reads, r.mapped) for r in totals(spark, str(tmp_path / "out")).collect()] == [(20, 20)] * (k + 1)


def test_bam_files_are_replaced_and_limits(spark, tmp_path):
    from types import SimpleNamespace

    from strandframe.sources.bam import record, write_bam

    row = dict(qname="q", flag=0, rname="chr", pos=1, mapq=9, cigar="4M", rnext="*", pnext=0, tlen=0, seq="ACGT", qual="IIII", nm=0, as_score=8, rg="sf")
    refs = spark.createDataFrame([(1, "chr", "ACGT")], "ref_id bigint, ref_name string, seq string")
    kinds = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, as_score int, rg string"
    rows = spark.createDataFrame([tuple(row.values())] * 8, kinds).repartition(4)
    for tasks in (4, 1):
        write_bam(rows.coalesce(tasks), refs, str(tmp_path / "bam"))
        assert len(list((tmp_path / "bam").iterdir())) == tasks
    with pytest.raises(ValueError, match="name"):
        record(SimpleNamespace(**row | {"qname": "x" * 300}), {"chr": 0})
    many = record(SimpleNamespace(**row | {"cigar": "1M1I" * 40_000, "seq": "A" * 80_000, "qual": "*"}), {"chr": 0})
    assert b"CGBI" + (80_000).to_bytes(4, "little") in many


def test_passes_and_evaluation_from_the_command_line(spark, tmp_path):
    from strandframe.__main__ import main

    rng = random.Random(12)
    refs = {f"chr{k}": "".join(rng.choice("ACGT") for _ in range(1500)) for k in range(3)}
    put(tmp_path / "refs.fa", "".join(f">{n}\n{s}\n" for n, s in refs.items()))
    reads = ""
    for i in range(30):
        name, p = f"chr{i % 3}", rng.randrange(1350)
        reads += f"@{name}_{p + 1}_{p + 1}_0_1_{i}\n{refs[name][p : p + 120]}\n+\n{'I' * 120}\n"
    put(tmp_path / "reads.fq", reads)
    at = lambda x: str(tmp_path / x)
    main(["build", at("refs.fa"), at("index")], spark)
    main(["map", at("index"), "-1", at("reads.fq"), "-o", at("one"), "--sort"], spark)
    main(["map", at("index"), "-1", at("reads.fq"), "-o", at("passes"), "--sort", "--pass-letters", "1500"], spark)
    lines = [[r.value for r in spark.read.text(at(f"{x}/body")).collect()] for x in ("one", "passes")]
    place = lambda line: line.split("\t")[:4]
    assert len(lines[0]) == 30 and list(map(place, lines[0])) == list(map(place, lines[1]))
    main(["evaluate", f"a={at('one/body')}", f"b={at('passes/body')}", "-o", at("metrics")], spark)
    rows = spark.read.option("header", True).csv(at("metrics")).collect()
    assert {(r.tool, r.tp, r.fp) for r in rows} == {("a", "30", "0"), ("b", "30", "0")}
