"""python -m strandframe build REFERENCES INDEX | map INDEX -1 READS [-2 READS] -o OUT | evaluate TOOL=SAM... -o OUT"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandframe.operators.evaluation import append_metrics
from strandframe.operators.index import build_index, read_index, write_index
from strandframe.operators.sam import write_sam
from strandframe.plans.evaluate import evaluate
from strandframe.plans.map_reads import map_reads, map_reads_in_passes
from strandframe.sources.bam import write_bam
from strandframe.sources.fastx import read_pairs, read_references, read_single


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandframe", description="Place short reads on references with Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="write an index of FASTA files")
    build.add_argument("references")
    build.add_argument("index")
    place = commands.add_parser("map", help="map FASTQ files")
    place.add_argument("index")
    place.add_argument("-1", dest="first", action="append", required=True)
    place.add_argument("-2", dest="second", action="append", default=[])
    place.add_argument("-o", dest="output", required=True)
    place.add_argument("--format", type=str.lower, choices=("sam", "bam"), default="sam")
    place.add_argument("--sort", action="store_true", help="by place, unmapped reads last")
    place.add_argument("--no-pairing", action="store_true")
    place.add_argument("--pass-letters", type=int, help="take the references in passes of about so many letters")
    judge = commands.add_parser("evaluate", help="accuracy of SAM files whose names carry the origins")
    judge.add_argument("runs", nargs="+", metavar="TOOL=SAM")
    judge.add_argument("-o", dest="output", required=True, help="folder that the metrics are added to")
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("strandframe").getOrCreate()
    if args.command == "build":
        read_references(spark, args.references).write.mode("overwrite").parquet(f"{args.index}/references")
        write_index(build_index(spark.read.parquet(f"{args.index}/references")), f"{args.index}/seeds")
        return
    if args.command == "evaluate":
        metrics, errors = evaluate(spark, dict(run.split("=", 1) for run in args.runs))
        append_metrics(metrics, args.output)
        errors.show(20, truncate=False)
        return
    if args.second and len(args.first) != len(args.second):
        parser.error(f"{len(args.first)} first files and {len(args.second)} second files")
    references = spark.read.parquet(f"{args.index}/references")
    if args.second:
        reads = read_pairs(spark, ",".join(args.first), ",".join(args.second))
    else:
        reads = read_single(spark, ",".join(args.first))
    options = {"pairing": "none" if args.no_pairing else "best", "sort": args.sort}
    if args.pass_letters:
        rows = map_reads_in_passes(reads, references, args.pass_letters, style="cli", **options)
    else:
        rows = map_reads(reads, read_index(spark, f"{args.index}/seeds", ranks=True), references, **options)
    if args.format == "bam":
        write_bam(rows, references, args.output, "coordinate" if args.sort else "unsorted")
    else:
        write_sam(rows, references, args.output, args.sort)


if __name__ == "__main__":
    main()
