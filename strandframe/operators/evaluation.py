"""Accuracy against planted truth, set overlaps and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.sequences import flag_set, truth_of


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(tp: Column, fp: Column, positives: Column) -> list[Column]:
    """Precision, recall and F1 as percentages, 0 where undefined."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, positives)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [(100 * p).alias("precision"), (100 * r).alias("recall"), (100 * f1).alias("f1")]


def truth_from_names(sam: DataFrame) -> DataFrame:
    """``qname, mate, ref, pos`` of both mates of every read whose name carries its origin.

    Rows of several tools may repeat a read; names of one read agree, so one is kept.
    """
    t = sam.select(truth_of(F.col("qname")).alias("t")).filter("t is not null").groupBy("t.qname").agg(F.min(F.struct("t.ref", "t.pos1", "t.pos2")).alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"t.pos{m}").alias("pos")) for m in (1, 2)]))
    return t.select("qname", F.col("t.ref").alias("ref"), each.alias("x")).select("qname", "x.mate", "ref", "x.pos")


def tool_results(sam: DataFrame, order: str = "row_no") -> DataFrame:
    """``tool, qname, mate, rname, pos`` of the last primary record of each mate; null place if unmapped or of no confidence.

    ``order`` is the column that says which record is later.
    """
    flag = F.col("flag")
    rows = sam.filter(~flag_set(flag, 256) & ~flag_set(flag, 2048))
    lost = flag_set(flag, 4) | (F.col("mapq") == 0) | (F.col("rname") == "*")
    at = F.when(~lost, F.struct("rname", "pos"))
    key = [F.col("tool"), F.split("qname", "/", 2)[0].alias("qname"), F.when(flag_set(flag, 128), 2).otherwise(1).alias("mate")]
    last = rows.select(*key, F.struct(F.col(order).alias("no"), at.alias("at")).alias("x")).groupBy("tool", "qname", "mate").agg(F.max_by("x", "x.no").alias("x"))
    return last.select("tool", "qname", "mate", F.col("x.at.rname").alias("rname"), F.col("x.at.pos").cast("bigint").alias("pos"))


def judged(truth: DataFrame, results: DataFrame, tolerance: int = 10) -> DataFrame:
    """Every true place with each tool's place and ``verdict``: TP, FP or FN."""
    tools = [r["tool"] for r in results.select("tool").distinct().orderBy("tool").collect()]  # tools are few, by their kind
    each = F.array(*[F.lit(t) for t in tools]) if tools else F.array().cast("array<string>")
    want = truth.select("*", F.explode(each).alias("tool"))
    got = results.withColumnsRenamed({"pos": "found"})
    hit = (F.col("rname") == F.col("ref")) & (F.abs(F.col("found") - F.col("pos")) <= tolerance)
    verdict = F.when(F.col("rname").isNull(), "FN").when(hit, "TP").otherwise("FP")
    return want.join(got, ["tool", "qname", "mate"], "left").withColumn("verdict", verdict)


def accuracy(judgement: DataFrame) -> DataFrame:
    """One row per tool: tp, fp, fn, precision, recall, f1."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    by_tool = judgement.groupBy("tool").agg(n("TP"), n("FP"), n("FN"))
    positives = F.col("tp") + F.col("fp") + F.col("fn")
    return by_tool.select("tool", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), positives))


def first_errors(judgement: DataFrame, limit: int = 20) -> DataFrame:
    """The first false places by name, with what is wrong."""
    why = F.when(F.col("rname") != F.col("ref"), "Wrong Ref").otherwise(F.concat(F.lit("Dist "), F.abs(F.col("found") - F.col("pos")).cast("string")))
    bad = judgement.filter("verdict = 'FP'").select("tool", "qname", "mate", "ref", "pos", "rname", "found", why.alias("error"))
    return bad.orderBy("qname", "mate", "tool").limit(limit)


def first_mate_accuracy(truth: DataFrame, sam: DataFrame, tolerance: int = 30) -> DataFrame:
    """Accuracy of first mates only, whatever their confidence: mapped, correct (nearer than the tolerance), recall, precision, f1 by tool."""
    flag = F.col("flag")
    rows = sam.filter(~flag_set(flag, 256) & ~flag_set(flag, 2048) & ~flag_set(flag, 4) & ~flag_set(flag, 128))
    rows = rows.select("tool", F.split("qname", "/", 2)[0].alias("qname"), "rname", F.col("pos").alias("found"))
    first = truth.filter("mate = 1")
    pairs = F.lit(first.count())
    right = (F.col("rname") == F.col("ref")) & (F.abs(F.col("found") - F.col("pos")) < tolerance)
    by_tool = rows.join(first, "qname").groupBy("tool").agg(F.count("*").alias("mapped"), F.count_if(right).alias("correct"))
    return by_tool.withColumn("pairs", pairs).select("tool", "pairs", "mapped", "correct", *scores(F.col("correct"), F.col("mapped") - F.col("correct"), F.col("pairs")))


def set_regions(sets: DataFrame, key: str, member: str, names: Sequence[str]) -> DataFrame:
    """``region`` and ``n``: how many distinct keys lie in exactly these of three or fewer sets; empty regions count 0.

    One shuffle by key instead of a chain of set operations. Null and empty keys are none.
    """
    keys = sets.filter((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""))
    flags = [F.max(F.when(F.col(member) == s, 1).otherwise(0)).alias(f"in{i}") for i, s in enumerate(names)]
    mask = sum((F.col(f"in{i}") * (1 << i) for i in range(len(names))), F.lit(0))
    counts = keys.groupBy(key).agg(*flags).select(mask.alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    regions = [(m, "&".join(s for i, s in enumerate(names) if m >> i & 1)) for m in range(1, 1 << len(names))]
    every = sets.sparkSession.createDataFrame(regions, "mask int, region string")
    return every.join(counts, "mask", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))


def variant_accuracy(truth: DataFrame, called: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of called keys against true ones, both taken as sets."""
    both = truth.select(key, F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(called.select(key, F.lit(0).alias("t"), F.lit(1).alias("c")))
    k = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("t").alias("t"), F.max("c").alias("c"))
    n = k.agg(F.count_if(F.expr("t = 1 and c = 1")).alias("tp"), F.count_if(F.expr("t = 0 and c = 1")).alias("fp"), F.count_if(F.expr("t = 1 and c = 0")).alias("fn"))
    return n.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn")))


def with_speed_up(runs: DataFrame, tool: str, time: str, baseline: str, group: Sequence[str]) -> DataFrame:
    """Adds ``speed_up``: the baseline tool's time over the row's, within a group; 0 if there is no baseline or no time."""
    base = F.max(F.when(F.col(tool) == baseline, F.col(time))).over(Window.partitionBy(*group))
    return runs.withColumn("speed_up", F.when(F.col(time) > 0, F.coalesce(base / F.col(time), F.lit(0.0))).otherwise(0.0))


def mapping_rate(mapped: DataFrame, by: Sequence[str]) -> DataFrame:
    """``total``, ``mapped`` and ``percent`` (two decimals) of rows with a boolean ``mapped``, by group."""
    n = mapped.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("mapped").alias("mapped"))
    return n.withColumn("percent", F.round(100 * _ratio(F.col("mapped"), F.col("total")), 2))


def prefix_totals(samples: DataFrame, order: str, value: str, steps: Sequence[int]) -> DataFrame:
    """``n`` and the total of the first n samples by ``order``, for each n of ``steps``; a step beyond the samples is left out.

    Samples are numbered in a table of at most ``max(steps)`` rows, by a top-k first.
    """
    top = samples.select(order, value).orderBy(order).limit(max(steps))
    numbered = top.withColumn("k", F.row_number().over(Window.orderBy(order)))
    whole = numbered.agg(F.max("k").alias("all"))
    wanted = samples.sparkSession.createDataFrame([(s,) for s in steps], "n int")
    rows = wanted.join(F.broadcast(whole), F.col("n") <= F.col("all")).join(F.broadcast(numbered), F.col("k") <= F.col("n"))
    return rows.groupBy("n").agg(F.sum(value).alias("total"))


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``work`` without a finished one of the same keys."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def experiment_grid(spark, coverages=(1, 3), mutations=(0.001, 0.01), tools=("a", "b")) -> DataFrame:
    """Every combination of coverage, mutation rate and tool."""
    every = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = spark.range(0, 1, 1, 1).select(every(coverages).alias("coverage")).select("*", every(mutations).alias("mutation"))
    return rows.select("*", every(tools).alias("tool"))


def run_summary(rows: DataFrame, references: DataFrame) -> DataFrame:
    """reads, mapped, percent, mapped_bases, genome_size, mean_coverage (0 for an empty reference) of SAM rows."""
    mapped = ~flag_set(F.col("flag"), 4)
    size = references.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    n = rows.agg(F.count("*").alias("reads"), F.count_if(mapped).alias("mapped"), F.coalesce(F.sum(F.when(mapped, F.length("seq"))), F.lit(0)).alias("mapped_bases"))
    out = n.withColumn("genome_size", F.lit(size).cast("bigint"))
    percent = F.round(100 * _ratio(F.col("mapped"), F.col("reads")), 2).alias("percent")
    return out.select("reads", "mapped", percent, "mapped_bases", "genome_size", _ratio(F.col("mapped_bases"), F.col("genome_size")).alias("mean_coverage"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows of metrics to a folder of CSV files with a header."""
    metrics.coalesce(1).write.mode("append").option("header", True).csv(path)  # metrics are a few rows


def longest_references(references: DataFrame, n: int) -> DataFrame:
    """The n longest references; ties by id."""
    return references.filter("seq is not null").select("ref_id", "ref_name", F.length("seq").alias("length")).orderBy(F.desc("length"), "ref_id").limit(n)


