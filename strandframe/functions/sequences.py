"""Column functions over bases, qualities, names, flags and CIGARs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR_TYPE = "array<struct<len:int,op:string>>"


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, null for any other letter."""
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at)


def reverse_complement_upper(seq: Column) -> Column:
    """Reverse complement in upper case for seeding; other letters become N."""
    return F.regexp_replace(F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement for output, which keeps the case; other letters become N."""
    return F.regexp_replace(F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca"), "[^ACGTacgt]", "N")


def oriented(seq: Column, qual: Column, is_rev: Column) -> tuple[Column, Column]:
    """Sequence and quality as they stand on the forward strand of the reference."""
    return F.when(is_rev, reverse_complement(seq)).otherwise(seq), F.when(is_rev, F.reverse(qual)).otherwise(qual)


def read_name(name: Column) -> Column:
    """First word of a header without a trailing /1 or /2."""
    return F.regexp_replace(F.split(F.trim(name), r"\s+", 2)[0], "/[12]$", "")


def reference_name(name: Column, ref_id: Column) -> Column:
    """First word of a header; an empty or null one is named by the id."""
    word = F.split(F.trim(name), r"\s+", 2)[0]
    return F.coalesce(F.when(word != "", word), F.concat(F.lit("ref_"), ref_id.cast("string")))


def truth_of(name: Column) -> Column:
    """Struct (qname, ref, pos1, pos2) that the name of a simulated read carries; null for another name."""
    clean = F.split(name, "/", 2)[0]
    pattern = F.lit(r"^(.*?)_(\d+)_(\d+)_([01])_([01])_")
    part = lambda i: F.regexp_extract(clean, r"^(.*?)_(\d+)_(\d+)_([01])_([01])_", i)
    found = F.struct(clean.alias("qname"), part(1).alias("ref"), part(2).cast("bigint").alias("pos1"), part(3).cast("bigint").alias("pos2"))
    return F.when(F.regexp_like(clean, pattern), found)


def flag_set(flag: Column, bit: int) -> Column:
    """Whether a SAM flag has a bit."""
    return flag.bitwiseAND(bit) != 0


def tag_value(tags: Column, tag: str) -> Column:
    """Integer value of a SAM tag such as NM from the array of optional fields; the first one counts."""
    return F.get(F.filter(tags, lambda t: t.startswith(f"{tag}:i:")), F.lit(0)).substr(6, 12).cast("int")


def cigar_span(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR covers."""
    return F.aggregate(cigar, F.lit(0), lambda n, x: n + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def cigar_text(cigar: Column) -> Column:
    """A CIGAR as text, * if it is empty."""
    text = F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(cigar) > 0, text).otherwise("*")


def estimated_reads(size: Column, gzipped: Column) -> Column:
    """Number of reads that a FASTQ file of so many bytes is taken to hold."""
    return F.floor(F.when(gzipped, size * 3.5).otherwise(size) / 400).cast("bigint")


def is_nuclear(name: Column) -> Column:
    """Whether a reference is neither an organelle (a word of its name is ct, pt or mt) nor an unplaced piece."""
    low = F.lower(name)
    organelle = F.arrays_overlap(F.split(low, "[^a-z]+"), F.array(F.lit("ct"), F.lit("pt"), F.lit("mt")))
    return ~(organelle | low.contains("scaffold") | low.contains("contig"))
