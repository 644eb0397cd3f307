"""FASTA, FASTQ and SAM files as DataFrames, and their discovery.

``format("fastx")`` is a Python data source that yields Arrow batches. A plain file is cut
into byte ranges; each task reads the records that begin in its range, so a file of any size
is spread over many tasks. A gzipped file (told by its first two bytes) can't be cut and is
read as a stream by one task, as is a pair of files, whose records belong together by their order.
Files are opened by ``pyarrow.fs``: local paths, or URIs that it knows (``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import gzip
import io
import os
import posixpath
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.functions.sequences import tag_value

#: Bytes of a range of a plain file.
SPLIT = 64 << 20
#: Records and bytes of a batch, about.
BATCH, BATCH_BYTES = 8192, 16 << 20

Record = tuple[int, str, str, str | None]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _open(path: str):
    system, at = _place(path)
    file = io.BufferedReader(system.open_input_file(at), 1 << 20)
    packed = file.peek(2)[:2] == b"\x1f\x8b"
    return gzip.GzipFile(fileobj=file) if packed else file


def _name(header: bytes) -> str:
    words = header[1:].split(None, 1)
    return words[0].decode("latin-1") if words else ""


def _lines(file, begin: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin at or after a byte, with the byte they begin at."""
    at = begin
    if begin:
        file.seek(begin - 1)
        at += len(file.readline()) - 1
    for line in file:
        yield at, line
        at += len(line)


def _kind(path: str) -> bytes:
    """The first letter of a file that isn't white space: ``>`` of FASTA, ``@`` of FASTQ; empty for an empty file."""
    with _open(path) as file:
        for line in file:
            if line.strip():
                if line[:1] not in (b">", b"@"):
                    raise ValueError(f"{path} is neither FASTA nor FASTQ")
                return line[:1]
    return b""


def _fasta(lines: Iterator[tuple[int, bytes]], end: float) -> Iterator[Record]:
    at, name, parts = -1, "", []
    for place, line in lines:
        if line.startswith(b">"):
            if at >= 0:
                yield at, name, b"".join(parts).decode("latin-1"), None
            at, name, parts = place, _name(line), []
            if place >= end:
                return
        elif at >= 0:
            parts.append(line.strip())
    if at >= 0:
        yield at, name, b"".join(parts).decode("latin-1"), None


def _fastq(path: str, lines: Iterator[tuple[int, bytes]], begin: int, end: float) -> Iterator[Record]:
    none = (-1, b"")
    waiting: list[tuple[int, bytes]] = []
    if begin:  # a record begins where a line with @ is followed by any line and one with +; a quality with @ isn't
        waiting = [x for x in (next(lines, none) for _ in range(3)) if x[0] >= 0]
        while len(waiting) == 3 and not (waiting[0][1].startswith(b"@") and waiting[2][1].startswith(b"+")):
            waiting = waiting[1:] + [x for x in [next(lines, none)] if x[0] >= 0]
        if len(waiting) < 3:
            return
    else:
        first = next((x for x in lines if x[1].strip()), none)
        waiting = [first] if first[0] >= 0 else []

    def line():
        return waiting.pop(0) if waiting else next(lines, none)

    at, header = line()
    while header.strip() and at < end:
        seq, plus, qual = (line()[1].rstrip(b"\r\n") for _ in range(3))
        if not header.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
            raise ValueError(f"{path}: broken record {header.strip().decode('latin-1')!r}")
        yield at, _name(header), seq.decode("latin-1"), qual.decode("latin-1")
        at, header = line()


def records(path: str, kind: bytes | None = None, begin: int = 0, end: float = float("inf")) -> Iterator[Record]:
    """(place, name, sequence, quality or None) of each record of a FASTA or FASTQ file that begins in a range of bytes.

    FASTA sequences may span lines. A broken record raises ``ValueError``.
    """
    kind = _kind(path) if kind is None else kind
    if not kind:
        return
    with _open(path) as file:
        lines = _lines(file, begin)
        yield from _fasta(lines, end) if kind == b">" else _fastq(path, lines, begin, end)


def _listed(path: str) -> list[str]:
    """Files of a comma-separated list of files, folders and patterns, sorted."""
    found = []
    for one in path.split(","):
        system, at = _place(one)
        root = one[: len(one) - len(at)] if "://" in one and one.endswith(at) else ""
        folder, pattern = (at, "*") if system.get_file_info(at).type == fs.FileType.Directory else posixpath.split(at)
        inside = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found += [root + f.path for f in inside if f.type == fs.FileType.File and fnmatch(posixpath.basename(f.path), pattern)]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _schema(numbers: list[str], texts: list[str]) -> pa.Schema:
    return pa.schema([*[(c, pa.int64()) for c in numbers], *[(c, pa.string()) for c in texts]])


class _Range(InputPartition):
    def __init__(self, number: int, path: str, kind: bytes, begin: int, end: float):
        self.number, self.path, self.kind, self.begin, self.end = number, path, kind, begin, end


class _Pair(InputPartition):
    def __init__(self, number: int, first: str, second: str):
        self.number, self.first, self.second = number, first, second


class _Single(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        out = []
        for i, path in enumerate(_listed(self.path)):
            kind = _kind(path)
            system, at = _place(path)
            with _open(path) as file:
                whole = isinstance(file, gzip.GzipFile)
            size = system.get_file_info(at).size
            begins = [0] if whole else list(range(0, max(size, 1), self.split))
            out += [_Range(i, path, kind, b, float("inf") if b == begins[-1] else b + self.split) for b in begins]
        return out

    def read(self, part):
        rows = ((part.number, at, name, seq, qual) for at, name, seq, qual in records(part.path, part.kind, part.begin, part.end))
        yield from _batches(rows, _schema(["file_no", "place"], ["name", "seq", "qual"]))


class _Paired(DataSourceReader):
    def __init__(self, first: str, second: str, uneven: str):
        self.first, self.second, self.uneven = first, second, uneven

    def partitions(self):
        a, b = _listed(self.first), _listed(self.second)
        if len(a) != len(b):
            raise ValueError(f"{len(a)} first files and {len(b)} second files")
        return [_Pair(i, *pair) for i, pair in enumerate(zip(a, b))]

    def _rows(self, part):
        one, two = records(part.first), records(part.second)
        while True:
            x, y = next(one, None), next(two, None)
            if x is None or y is None:
                if (x or y) and self.uneven != "truncate":
                    raise ValueError(f"{part.first} and {part.second} hold different numbers of records")
                return
            yield (part.number << 40) + x[0], re.sub(r"/[12]$", "", x[1]), x[2], x[3] or "*", y[2], y[3] or "*"

    def read(self, part):
        yield from _batches(self._rows(part), _schema(["read_id"], ["name", "seq1", "qual1", "seq2", "qual2"]))


class FastxSource(DataSource):
    """Option ``path``: files, folders or patterns, separated by commas; or ``path1`` and ``path2`` for pairs.

    Single files give ``file_no, place, name, seq, qual`` with the number of the file in the sorted
    list and the byte (of the unpacked file) that the record begins at; pairs give ``read_id, name,
    seq1, qual1, seq2, qual2``. Pairs of unequal length raise, unless ``uneven`` is
    ``truncate``. Option ``split``: bytes of a range.
    """

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        if "path1" in self.options:
            return "read_id bigint, name string, seq1 string, qual1 string, seq2 string, qual2 string"
        return "file_no bigint, place bigint, name string, seq string, qual string"

    def reader(self, schema):
        if "path1" in self.options:
            return _Paired(self.options["path1"], self.options["path2"], self.options.get("uneven", "raise"))
        return _Single(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def _id():
    """One number from the file and the place in it."""
    return F.shiftleft("file_no", 40) + F.col("place")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``ref_id, ref_name, seq``; ids from file and place, in the order of the files."""
    register(spark)
    rows = spark.read.format("fastx").option("path", path).load()
    return rows.select(_id().alias("ref_id"), F.col("name").alias("ref_name"), "seq")


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """Single-end reads in the columns of pairs, the second mate null."""
    register(spark)
    rows = spark.read.format("fastx").option("path", path).load()
    none = F.lit(None).cast("string")
    return rows.select(
        _id().alias("read_id"), F.regexp_replace("name", "/[12]$", "").alias("name"),
        F.col("seq").alias("seq1"), F.coalesce("qual", F.lit("*")).alias("qual1"), none.alias("seq2"), none.alias("qual2"),
    )


def read_pairs(spark: SparkSession, first: str, second: str, uneven: str = "raise") -> DataFrame:
    register(spark)
    return spark.read.format("fastx").option("path1", first).option("path2", second).option("uneven", uneven).load()


def read_sam(spark: SparkSession, path: str, *more) -> DataFrame:
    """Records of SAM text files: the eleven columns, ``nm`` and ``as_score``, and ``more`` columns of the text scan; header lines are left out."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    text = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    number = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [F.get(f, F.lit(i)).cast("int" if c in number else "string").alias(c) for i, c in enumerate(text)]
    tags = F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))
    return lines.filter(F.size(f) >= 11).select(*cols, tag_value(tags, "NM").alias("nm"), tag_value(tags, "AS").alias("as_score"), *more)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``name, ref, pos`` of a tab-separated file."""
    return spark.read.csv(path, sep="\t", schema="name string, ref string, pos bigint")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty lines."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("key")).distinct()


def sample_pairs(paths: DataFrame, path: str = "path", first: str = "_1", second: str = "_2") -> DataFrame:
    """``sample, path1, path2`` of complete pairs of files; names differ by ``first`` and ``second`` before the suffix."""
    split = paths.select(F.regexp_extract(path, rf"^(.*)({re.escape(first)}|{re.escape(second)})(\.[^/]*)$", 1).alias("s"), F.regexp_extract(path, rf"^(.*)({re.escape(first)}|{re.escape(second)})(\.[^/]*)$", 2).alias("m"), F.col(path).alias("p"))
    sides = split.filter("s <> ''").groupBy("s").agg(F.min(F.when(F.col("m") == first, F.col("p"))).alias("path1"), F.min(F.when(F.col("m") == second, F.col("p"))).alias("path2"))
    return sides.filter("path1 is not null and path2 is not null").select(F.regexp_extract("s", "([^/]*)$", 1).alias("sample"), "path1", "path2")
