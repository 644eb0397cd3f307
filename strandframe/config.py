"""Constants of the mapper."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapperConfig:
    """Defaults are the values that placements are defined by."""

    kmer: int = 21
    smer: int = 6
    match: int = 2
    mismatch: int = -2
    gap: int = -2
    x_drop: int = 15
    most_per_remainder: int = 500  #: seeds whose 24-bit remainder is commoner are dropped from the index
    most_per_probe: int = 100
    most_per_read: int = 7500
    least_votes: int = 2
    lookahead: int = 4
    pair_distance: int = 1000
    read_group: str = "sf"


CONFIG = MapperConfig()

# The numbers that stand for A, C, G, T in the rolling hash, and its multiplier; the bits of
# the doubles e - 2, pi - 3, sqrt(2) - 1, sqrt(3) - 1 and 1.618033988749.
BASE_HASH = (0x3FE6FC2A2C515DA4, 0x3FC21FB54442D180, 0x3FDA827999FCEF34, 0x3FE76CF5D0B09954)
MULTIPLIER = 0x3FF9E3779B97E4EA
