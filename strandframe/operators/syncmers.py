"""Closed syncmers of sequences, in closed form over Arrow batches.

The rolling hash of a window is an XOR of rotated base numbers, so with a prefix XOR
every window's hash is a difference: h(p) = rotl(X[p+w] ^ X[p], p+w-1) * MULTIPLIER.
A k-mer is kept if the least s-mer in it (the rightmost among equal ones, compared as
unsigned numbers) is its first or its last. Windows with another letter than A, C, G,
T don't count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.config import BASE_HASH, CONFIG, MULTIPLIER, MapperConfig

#: Bases that are looked at in one go.
CHUNK = 1 << 20

CODES = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(b"ACGT"):
    CODES[_b] = CODES[_b + 32] = _i

_ROTATED = np.zeros((5, 64), dtype=np.uint64)
for _i, _v in enumerate(BASE_HASH):
    for _r in range(64):
        _ROTATED[_i, _r] = ((_v >> _r) | (_v << (64 - _r))) & (2**64 - 1)


def _hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window of ``width`` bases from each place on."""
    x = prefix[width:] ^ prefix[:-width]
    turn = ((np.arange(len(x), dtype=np.uint64) + np.uint64(width - 1)) & np.uint64(63)).astype(np.uint64)
    back = (np.uint64(64) - turn) & np.uint64(63)
    return ((x << turn) | (x >> back)) * np.uint64(MULTIPLIER)


def syncmers_of(codes: np.ndarray, cfg: MapperConfig = CONFIG) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the syncmers of base codes (above 3: no base)."""
    k, s = cfg.kmer, cfg.smer
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    rotated = _ROTATED[codes, np.arange(len(codes)) & 63]
    prefix = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(rotated)))
    small = _hashes(prefix, s)
    inner = k - s  # further s-mers in a k-mer
    rest = small[1:]  # least of the s-mers after the first one, by doubling
    span = 1
    while span < inner:
        step = min(span, inner - span)
        rest = np.minimum(rest[:-step], rest[step:])
        span += step
    rest, first, last = rest[:n], small[:n], small[inner : inner + n]
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    keep = (first < rest) | ((last <= first) & (last == rest))
    at = np.flatnonzero(keep & (bad[k:] == bad[:-k]))
    return at, _hashes(prefix, k)[at]


def _task(cfg: MapperConfig, strands: bool, keys: int):
    complement = np.array([3, 2, 1, 0, 4], dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keys)
            first = 0
            while first < batch.num_rows:
                parts, size, last = [], 0, first
                while last < batch.num_rows and (last == first or size < CHUNK):
                    parts.append(texts[last].as_py().encode("ascii", "replace") + b"\n")
                    size += len(parts[-1])
                    last += 1
                ends = np.cumsum([len(p) for p in parts])
                codes = CODES[np.frombuffer(b"".join(parts), dtype=np.uint8)]
                for rev in (False, True)[: 1 + strands]:
                    used = complement[codes[::-1]] if rev else codes
                    for begin in range(0, len(used), CHUNK):
                        at, hashes = syncmers_of(used[begin : begin + CHUNK + cfg.kmer - 1], cfg)
                        at = at + begin
                        if not len(at):
                            continue
                        if rev:  # the reversed chunk begins with the last row's line end
                            row = len(parts) - 1 - np.searchsorted(np.cumsum([len(p) for p in parts[::-1]]), at, side="right")
                            pos = at - (len(codes) - ends[row]) - 1
                        else:
                            row = np.searchsorted(ends, at, side="right")
                            pos = at - (ends[row] - np.array([len(p) for p in parts])[row])
                        picked = pa.array(row + first)
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[batch.column(i).take(picked) for i in range(keys)],
                                *([pa.array(np.full(len(at), rev))] if strands else []),
                                pa.array((hashes >> np.uint64(20)).astype(np.int64)),
                                pa.array(pos.astype(np.int32)),
                            ],
                            names=[*batch.schema.names[:keys], *(["is_rev"] if strands else []), "key44", "pos"],
                        )
                first = last

    return run


def explode_syncmers(df: DataFrame, keys: Sequence[str], seq: str, both_strands: bool = False, cfg: MapperConfig = CONFIG) -> DataFrame:
    """``keys``, ``is_rev`` (with ``both_strands``), ``key44`` and ``pos`` of every syncmer.

    ``key44`` holds the upper 44 bits of the hash, ``pos`` is 0-based; on the reverse
    strand it counts from the start of the reverse complement. Null sequences and those
    shorter than a k-mer have none. Other columns are left out; a key column must not
    bear the name of a result column.
    """
    clash = set(keys) & {"is_rev", "key44", "pos"}
    if clash:
        raise ValueError(f"key columns clash with the result's: {sorted(clash)}")
    rows = df.filter(F.length(seq) >= cfg.kmer).select(*keys, F.col(seq).alias("__seq"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(_task(cfg, both_strands, len(keys)), f"{kinds}, {'is_rev boolean, ' if both_strands else ''}key44 bigint, pos int")
