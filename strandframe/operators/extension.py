"""Extension of candidates to alignments: greedy steps with a short look ahead and an x-drop.

Candidates meet their read and the part of the reference that the extension can reach;
the walk itself runs in Arrow batches. Equal stretches are passed over at once by the
places where the diagonal differs, so a walk costs as many steps as it has events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.config import CONFIG, MapperConfig
from strandframe.functions.sequences import CIGAR_TYPE, reverse_complement_upper
from strandframe.operators.seeding import READ, mates

#: Letters are compared regardless of case, and N is taken for A.
_LETTER = np.array([i | 0x20 for i in range(256)], dtype=np.uint8)
_LETTER[ord("N")] = _LETTER[ord("n")] = ord("a")

Walk = tuple[int, int, int, list[tuple[int, str]], int]


def walk(a: np.ndarray, b: np.ndarray, keep_last: bool, cfg: MapperConfig = CONFIG) -> Walk:
    """Best extension from the start of read ``a`` along reference ``b``.

    Returns score, letters used of both, events in order and edits. At an event the step
    with most matches among the next ``lookahead`` places is taken: substitution before
    deletion before insertion. ``keep_last``: a gap may not use up the last letter.
    """
    n, m = len(a), len(b)
    i = j = score = edits = 0
    events: list[tuple[int, str]] = []
    best = (0, 0, 0, 0, 0)  # score, i, j, number of events, edits
    shift, differ = None, np.zeros(0, dtype=np.int64)

    def ahead(x: int, y: int) -> int:
        if x >= n or y >= m:
            return 0
        k = min(cfg.lookahead, n - x, m - y)
        return int(np.count_nonzero(a[x : x + k] == b[y : y + k]))

    while i < n and j < m:
        if shift != j - i:
            shift = j - i
            k = min(n - i, m - j)
            differ = np.flatnonzero(a[i : i + k] != b[j : j + k]) + i
        at = np.searchsorted(differ, i)
        run = int(differ[at] if at < len(differ) else min(n, m - shift)) - i
        if run:
            events.append((run, "M"))
            score += cfg.match * run
            i, j = i + run, j + run
        else:
            sub, gap_b, gap_a = ahead(i + 1, j + 1), ahead(i, j + 1), ahead(i + 1, j)
            sub, gap_b, gap_a = cfg.mismatch + sub * cfg.match, cfg.gap + gap_b * cfg.match, cfg.gap + gap_a * cfg.match
            if sub >= gap_b and sub >= gap_a:
                events.append((1, "M"))
                score, i, j = score + cfg.mismatch, i + 1, j + 1
            elif gap_b >= gap_a and not (keep_last and j + 1 >= m):
                events.append((1, "D"))
                score, j = score + cfg.gap, j + 1
            elif not (keep_last and i + 1 >= n):
                events.append((1, "I"))
                score, i = score + cfg.gap, i + 1
            else:
                break
            edits += 1
        if score > best[0]:
            best = (score, i, j, len(events), edits)
        if score < best[0] - cfg.x_drop:
            break
    return best[0], best[1], best[2], events[: best[3]], best[4]


def extend(read: bytes, reference: bytes, anchor: int, diag: int, cfg: MapperConfig = CONFIG):
    """(pos, score, edits, aligned letters, CIGAR as (length, op) list) of a candidate."""
    a, b = _LETTER[np.frombuffer(read, np.uint8)], _LETTER[np.frombuffer(reference, np.uint8)]
    start = min(diag + anchor, max(len(b) - 1, 0)) if diag >= 0 else max(anchor + diag, 0)
    left = walk(a[:anchor][::-1], b[:start][::-1], True, cfg)
    right = walk(a[anchor:], b[start:], False, cfg)
    begin, end = anchor - left[1], anchor + right[1]
    cigar: list[tuple[int, str]] = []
    for size, op in [(begin, "S"), *reversed(left[3]), *right[3], (len(a) - end, "S")]:
        if size and cigar and cigar[-1][1] == op:
            cigar[-1] = (cigar[-1][0] + size, op)
        elif size:
            cigar.append((size, op))
    return start - left[2], left[0] + right[0], left[4] + right[4], end - begin, cigar


def _task(cfg: MapperConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("pos", "nm", "as_score", "cigar")}
            kept = []
            col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seq", "part", "part_start", "ref_len", "anchor", "diag")}
            for k in range(batch.num_rows):
                shift = col["part_start"][k]
                # Places are those of the part; a diagonal below zero is so in the whole reference too.
                diag = col["diag"][k] - shift
                pos, score, edits, aligned, cigar = extend(
                    col["seq"][k].encode("ascii", "replace"), col["part"][k].encode("ascii", "replace"), col["anchor"][k], diag, cfg
                )
                if aligned and 0 <= pos + shift < col["ref_len"][k]:
                    kept.append(k)
                    for c, v in zip(out, (pos + shift, edits, score, [{"len": n, "op": op} for n, op in cigar])):
                        out[c].append(v)
            picked = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)).take(picked) for c in (*READ, "vote_rank", "ref_id", "is_rev", "mapq")],
                    *[pa.array(out[c], pa.int32()) for c in ("pos", "nm", "as_score")],
                    pa.array(out["cigar"], pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))),
                ],
                names=[*READ, "vote_rank", "ref_id", "is_rev", "mapq", "pos", "nm", "as_score", "cigar"],
            )

    return run


#: Letters of a reference tile, at least.
TILE = 1 << 14


def reference_tiles(references: DataFrame, tile: int, margin: int) -> DataFrame:
    """``ref_id``, ``tile``, ``ref_len`` and ``piece``: tiles of all references, each with the ``margin`` letters that follow it.

    References are cut in one pass over their letters; null and empty ones have no tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, seq in zip(batch.column(0), batch.column(1)):
                text = seq.as_py().encode("ascii", "replace")
                for first in range(0, len(text), 64 * tile):
                    starts = range(first, min(len(text), first + 64 * tile), tile)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ref.as_py()] * len(starts), pa.int64()),
                            pa.array([x // tile for x in starts], pa.int64()),
                            pa.array([len(text)] * len(starts), pa.int64()),
                            pa.array([text[x : x + tile + margin].decode("ascii") for x in starts]),
                        ],
                        names=["ref_id", "tile", "ref_len", "piece"],
                    )

    rows = references.filter(F.length("seq") > 0).select(F.col("ref_id").cast("bigint"), "seq")
    return rows.mapInArrow(run, "ref_id bigint, tile bigint, ref_len bigint, piece string")


def extend_candidates(candidates: DataFrame, reads: DataFrame, references: DataFrame, cfg: MapperConfig = CONFIG) -> DataFrame:
    """Alignments of candidates: read, ``rank`` (1, 2 by score), ref_id, pos, is_rev, mapq, cigar, nm, as_score.

    ``references`` has ``ref_id`` and ``seq``. Candidates whose extension is empty or
    leaves the reference are dropped. References are cut into tiles once, which overlap by
    what the longest read can reach (a walk of n letters can't skip more than n plus the
    x-drop), and a candidate meets the one tile that holds its part: its cost doesn't depend on
    the reference's length, and the candidates of one reference spread over its tiles.
    """
    seqs = mates(reads).withColumnRenamed("seq", "__seq")
    longest = reads.agg(F.max(F.greatest(F.length("seq1"), F.length("seq2")))).first()[0] or 0
    most = 2 * longest + 2 * cfg.x_drop + 2 * cfg.lookahead
    tile = max(TILE, 4 * most)
    tiles = reference_tiles(references, tile, 2 * most).select(F.col("ref_id").alias("__ref"), F.col("tile").alias("__tile"), "ref_len", F.col("piece").alias("__piece"))
    reach = 2 * F.length("__seq") + 2 * cfg.x_drop + 2 * cfg.lookahead
    # The part starts at the reference's start or out of reach, and the same holds for its end.
    from_ = F.greatest(F.lit(0), F.col("diag") + F.col("anchor") - reach).cast("bigint")
    placed = candidates.join(seqs, READ).withColumn("__from", from_).withColumn("__length", F.col("diag") + F.col("anchor") + reach - F.col("__from"))
    both = placed.join(tiles, (F.col("ref_id") == F.col("__ref")) & (F.expr(f"__from div {tile}") == F.col("__tile")))
    inputs = both.select(
        *READ, "vote_rank", "ref_id", "is_rev", "mapq", "anchor", "diag",
        F.when(F.col("is_rev"), reverse_complement_upper(F.col("__seq"))).otherwise(F.col("__seq")).alias("seq"),
        F.substring("__piece", (F.col("__from") % tile + 1).cast("int"), F.col("__length").cast("int")).alias("part"),
        F.col("__from").alias("part_start"),
        "ref_len",
    )
    found = inputs.mapInArrow(
        _task(cfg), f"read_id bigint, mate int, vote_rank int, ref_id bigint, is_rev boolean, mapq int, pos int, nm int, as_score int, cigar {CIGAR_TYPE}"
    )
    order = Window.partitionBy(*READ).orderBy(F.desc("as_score"), "vote_rank")
    return found.select(*READ, F.row_number().over(order).alias("rank"), "ref_id", "pos", "is_rev", "mapq", "cigar", "nm", "as_score")
