"""Most frequent values of a column by code-based identification, in bounded memory.

Let a value be frequent if it holds at least ``share`` of the total weight.

1. Values are hashed to groups, several times over; the weight of each group is an
   ordinary aggregate. Only groups of at least the frequent weight go on: there are
   at most 1/share of them in each repetition, whatever the data.
2. In those groups each value is encoded as a word of an error-correcting code: two
   Reed-Solomon words over 16 symbols, each 8 symbols of the value and 4 of check.
   For each group and position the weights of the 16 symbols are summed, first in the
   task, then by Spark.
3. The heaviest symbol of each position gives a received word; decoding corrects up
   to two wrong positions in each half and yields the candidate of the group.
4. Candidates (at most repetitions/share) are counted exactly. A group whose weight
   is not explained by candidates might hide another frequent value only if it is
   such a group in every repetition; the rows of those groups, if there are any, are
   counted exactly by value, so the result is whole in every case.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, CHECK = 8, 4
WORD = DATA + CHECK
HALVES = 2

# Arithmetic of the field of 16 elements, from its generator 2 and x^4 + x + 1.
EXP = np.zeros(30, dtype=np.int64)
LOG = np.zeros(16, dtype=np.int64)
_x = 1
for _i in range(15):
    EXP[_i] = EXP[_i + 15] = _x
    LOG[_x] = _i
    _x = (_x << 1) ^ (0b10011 if _x & 8 else 0)


def gf_mul(a, b):
    """Product in the field, elementwise."""
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


def _check_matrix() -> np.ndarray:
    """Rows give the check symbols of each data position: x^(CHECK + i) modulo the generator polynomial."""
    generator = [1]
    for root in range(CHECK):
        up, shifted = [*generator, 0], [0, *[int(gf_mul(EXP[root], c)) for c in generator]]
        generator = [p ^ q for p, q in zip(up, shifted)]
    rows = []
    for i in range(DATA):
        rest = [0] * CHECK  # coefficients from the highest down
        for k in range(CHECK + i + 1):
            lead = rest[0] if k else 0
            carry = 1 if k == 0 else 0
            rest = [*rest[1:], 0]
            rest[-1] ^= carry
            rest = [r ^ int(gf_mul(lead, c)) for r, c in zip(rest, generator[1:])]
        rows.append(rest)
    return np.array(rows)


PARITY = _check_matrix()


def encode(values: np.ndarray) -> np.ndarray:
    """Symbols of each value, shape (HALVES, WORD, n); position j holds the coefficient of x^(WORD-1-j)."""
    bits = values.astype(np.uint64)
    out = np.zeros((HALVES, WORD, len(values)), dtype=np.int64)
    for h in range(HALVES):
        for i in range(DATA):
            out[h, DATA - 1 - i] = ((bits >> np.uint64(4 * (h * DATA + i))) & np.uint64(15)).astype(np.int64)
        for i in range(DATA):
            symbol = out[h, DATA - 1 - i]
            for c in range(CHECK):
                out[h, DATA + c] ^= gf_mul(symbol, PARITY[i, c])
    return out


def decode_half(word: np.ndarray) -> int | None:
    """The data of a received word with at most CHECK/2 wrong symbols; None if there is none so near."""

    def syndromes(w):
        return [int(np.bitwise_xor.reduce([int(gf_mul(s, EXP[(r * (WORD - 1 - j)) % 15])) for j, s in enumerate(w)])) for r in range(CHECK)]

    def data(w):
        return sum(int(w[DATA - 1 - i]) << (4 * i) for i in range(DATA))

    word = [int(x) for x in word]
    s = syndromes(word)
    if not any(s):
        return data(word)
    # The code is short, so wrong positions are found by trying: one, then two.
    inv = lambda a: int(EXP[(15 - LOG[a]) % 15])
    place = [int(EXP[WORD - 1 - j]) for j in range(WORD)]
    for j in range(WORD):
        if s[0] and all(s[r] == int(gf_mul(s[0], EXP[(LOG[place[j]] * r) % 15])) for r in range(CHECK)):
            fixed = list(word)
            fixed[j] ^= s[0]
            return data(fixed)
    for j in range(WORD):
        for k in range(j + 1, WORD):
            x, y = place[j], place[k]
            # e1 + e2 = s0 and e1 x + e2 y = s1
            e2 = int(gf_mul(s[1] ^ int(gf_mul(s[0], x)), inv(x ^ y)))
            e1 = s[0] ^ e2
            if e1 and e2:
                fixed = list(word)
                fixed[j] ^= e1
                fixed[k] ^= e2
                if not any(syndromes(fixed)):
                    return data(fixed)
    return None


def decode(words: np.ndarray) -> int | None:
    """The value of two received words, or None; the sign bit can't be set."""
    halves = [decode_half(words[h]) for h in range(HALVES)]
    if None in halves:
        return None
    value = halves[0] | halves[1] << (4 * DATA)
    return value if value < 2**63 else None


def _symbol_sums(slots: list[np.ndarray], count: int):
    """Task function: weights of the symbols by group and position; one row of 16 sums for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((HALVES * WORD, count * 16), dtype=np.int64)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            value, weight, *groups = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            words = encode(value).reshape(HALVES * WORD, -1)
            for r, group in enumerate(groups):
                slot = slots[r][group]
                inside = slot >= 0
                if not inside.any():
                    continue
                seen = True
                at, w = slot[inside], weight[inside]
                for p in range(HALVES * WORD):
                    np.add.at(sums[p], at * 16 + words[p][inside], w)
        if seen:
            cube = sums.reshape(HALVES * WORD, count, 16)
            pos, slot = np.nonzero(cube.any(axis=2))
            found = cube[pos, slot]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array(pos.astype(np.int32)), *[pa.array(found[:, s]) for s in range(16)]],
                names=["slot", "pos", *[f"s{s}" for s in range(16)]],
            )

    return run


def _hashes(repetitions: int, groups: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(r), F.col("value")), F.lit(groups)).cast("int").alias(f"g{r}") for r in range(repetitions)]


def heavy_hitters(df: DataFrame, value: str, share: float, weight: str | None = None, total: int | None = None, repetitions: int = 3) -> DataFrame:
    """``value`` and ``weight`` (exact) of each value with at least ``share`` of the total weight.

    ``total`` is the sum of all valid weights if not given. Null and negative values
    are no values, null weights and those below 1 count nothing. Memory in a task and
    on the driver is bounded by ``repetitions / share`` groups, not by the number of
    distinct values. Ties at the threshold are all kept, an empty table gives an empty
    result, other columns are left out.
    """
    spark = df.sparkSession
    heavy = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    groups = 1 << int(np.ceil(np.log2(8 / share)))
    rows = df.filter(F.col(value) >= 0)
    if weight:
        rows = rows.filter(F.col(weight) >= 1)
    rows = rows.select(F.col(value).cast("bigint").alias("value"), heavy.alias("weight")).select("*", *_hashes(repetitions, groups))
    if total is None:
        total = rows.agg(F.sum("weight")).first()[0] or 0
    exact = Fraction(share).limit_denominator(10**9)
    least = max(1, -(-total * exact.numerator // exact.denominator))

    def found_in(frame: DataFrame) -> DataFrame:
        return frame.groupBy("value").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= least)

    # 1. Heavy groups; their number is at most total/least in each repetition.
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(f"g{r}").alias("grp")) for r in range(repetitions)]))
    by_group = rows.select(each.alias("x"), "weight").groupBy("x.rep", "x.grp").agg(F.sum("weight").alias("weight"))
    heavy_groups = [(g["rep"], g["grp"], g["weight"]) for g in by_group.filter(F.col("weight") >= least).collect()] if total else []
    if not heavy_groups:
        return found_in(rows.select("value", "weight").limit(0))

    slots = [np.full(groups, -1, dtype=np.int64) for _ in range(repetitions)]
    for k, (rep, grp, _) in enumerate(heavy_groups):
        slots[rep][grp] = k

    def member(left: list[set[int]], every: bool):
        tests = [F.col(f"g{r}").isin(sorted(left[r])) if left[r] else F.lit(False) for r in range(repetitions)]
        out = tests[0]
        for t in tests[1:]:
            out = (out & t) if every else (out | t)
        return out

    inside = [{g for r2, g, _ in heavy_groups if r2 == r} for r in range(repetitions)]
    # 2. Symbol weights in the heavy groups.
    sums = (
        rows.filter(member(inside, every=False))
        .mapInArrow(_symbol_sums(slots, len(heavy_groups)), "slot int, pos int, " + ", ".join(f"s{s} bigint" for s in range(16)))
        .groupBy("slot", "pos")
        .agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(16)])
    )
    received = np.zeros((len(heavy_groups), HALVES * WORD), dtype=np.int64)
    for row in sums.collect():  # at most repetitions/share groups of 24 rows
        received[row["slot"], row["pos"]] = int(np.argmax(row[2:]))
    # 3. Decode.
    candidates = sorted({v for word in received if (v := decode(word.reshape(HALVES, WORD))) is not None})
    # 4. Exact counts, and what the candidates leave unexplained.
    listed = spark.createDataFrame([(v,) for v in candidates], "value bigint")
    exact = rows.select("value", "weight").join(F.broadcast(listed), "value").groupBy("value").agg(F.sum("weight").alias("weight"))
    counted = [(r["value"], r["weight"]) for r in exact.collect()]  # at most repetitions/share rows
    left = {(rep, grp): w for rep, grp, w in heavy_groups}
    known = spark.createDataFrame(counted, "value bigint, weight bigint").select("*", *_hashes(repetitions, groups))
    for row in known.collect():
        for r in range(repetitions):
            if (r, row[f"g{r}"]) in left:
                left[(r, row[f"g{r}"])] -= row["weight"]
    unexplained = [{g for (r2, g), w in left.items() if r2 == r and w >= least} for r in range(repetitions)]
    result = spark.createDataFrame([x for x in counted if x[1] >= least], "value bigint, weight bigint")
    if all(unexplained):
        rest = rows.filter(member(unexplained, every=True)).join(F.broadcast(listed), "value", "left_anti")
        result = result.unionByName(found_in(rest.select("value", "weight")))
    return result
