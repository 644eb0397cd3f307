"""BAM sink: SAM rows as a folder of BGZF-compressed BAM files, one complete file per task."""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Fixed values of the format: an empty block ends a file; letters of CIGAR and bases by their codes.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BLOCK = 60_000


def bgzf_block(data: bytes) -> bytes:
    """One gzip member whose extra field holds its size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(begin: int, end: int) -> int:
    """Smallest bin of the binning index that holds [begin, end)."""
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * (5 - level)) - 1) // 7 + (begin >> shift)
    return 0


def record(row, ids: dict[str, int]) -> bytes:
    """The bytes of one alignment."""
    cigar = [(int(n), OPS.index(op)) for n, op in re.findall(r"(\d+)(\D)", row.cigar)]
    span = sum(n for n, op in cigar if OPS[op] in "MDN=X") or 1
    ref = ids.get(row.rname, -1)
    other = ref if row.rnext == "=" else ids.get(row.rnext, -1)
    seq, pos = row.seq or "", row.pos - 1
    codes = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes(ord(c) - 33 for c in row.qual) if row.qual and row.qual != "*" and len(row.qual) == len(seq) else b"\xff" * len(seq)
    name = row.qname.encode() + b"\0"
    if len(name) > 255:
        raise ValueError(f"a name of {len(name) - 1} bytes doesn't fit the format: {row.qname[:40]!r}...")
    tags = b"".join(tag + b"i" + struct.pack("<i", v) for tag, v in ((b"NM", row.nm), (b"AS", row.as_score)) if v is not None)
    if row.rg is not None:
        tags += b"RGZ" + row.rg.encode() + b"\0"
    if len(cigar) > 0xFFFF:  # too many for their field: they go to a tag, and two operations of the same lengths stand in for them
        tags += b"CGBI" + struct.pack("<i", len(cigar)) + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar)
        cigar = [(len(seq), OPS.index("S")), (span, OPS.index("N"))]
    head = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row.mapq, bin_of(max(pos, 0), max(pos, 0) + span), len(cigar), row.flag, len(seq), other, row.pnext - 1, row.tlen)
    body = head + name + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, header: str, names: list[str], sizes: list[int], overwrite: bool):
        self.folder, self.header, self.names, self.sizes, self.overwrite = folder, header, names, sizes, overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"part-{context.partitionId():05d}.bam")
        ids = {n: i for i, n in enumerate(self.names)}
        text = self.header.encode()
        data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names))
        data += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in zip(self.names, self.sizes))
        temporary = f"{path}.{context.taskAttemptId()}"
        with open(temporary, "wb") as out:
            waiting = bytearray(data)
            for row in rows:
                waiting += record(row, ids)
                while len(waiting) >= BLOCK:
                    out.write(bgzf_block(bytes(waiting[:BLOCK])))
                    del waiting[:BLOCK]
            while waiting:
                out.write(bgzf_block(bytes(waiting[:BLOCK])))
                del waiting[:BLOCK]
            out.write(END)
        return _Written(temporary)

    def commit(self, messages) -> None:
        if self.overwrite:  # files of an earlier write with more tasks
            for old in glob.glob(os.path.join(glob.escape(self.folder), "part-*.bam")):
                os.remove(old)
        for m in messages:
            os.replace(m.path, m.path.rsplit(".", 1)[0])

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class BamSink(DataSource):
    """``format("bam")`` for SAM rows; options ``path``, ``header``, ``names`` and ``lengths`` (tab-separated)."""

    @classmethod
    def name(cls):
        return "bam"

    def writer(self, schema, overwrite):
        o = self.options
        return _Writer(o["path"], o["header"], o["names"].split("\t") if o["names"] else [], [int(x) for x in o["lengths"].split("\t") if x], overwrite)


def write_bam(rows: DataFrame, references: DataFrame, path: str, sort_order: str = "unsorted") -> None:
    """Write SAM rows below a folder that all executors share, in place of BAM files that are there.

    Every file repeats the header, as the format wants it, so references must be few
    enough for one (their names are collected: a header is one block of text by design).
    """
    from strandframe.operators.sam import sam_header

    spark = rows.sparkSession
    spark.dataSource.register(BamSink)
    lines = [r["value"] for r in sam_header(references, sort_order).orderBy("part", "line_no").collect()]
    fields = [dict(f.split(":", 1) for f in x.split("\t")[1:]) for x in lines if x.startswith("@SQ")]
    out = rows.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nm", "as_score", "rg")
    options = {"path": path, "header": "\n".join(lines) + "\n", "names": "\t".join(f["SN"] for f in fields), "lengths": "\t".join(f["LN"] for f in fields)}
    out.write.format("bam").options(**options).mode("overwrite").save()
