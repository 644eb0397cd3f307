"""Long exact spans shared between records, found with suffix automata of reference shards.

1. A stretch of ``min_len`` letters that stands in two records has the same smallest
   word of ``ANCHOR`` letters (an anchor) in both. Anchors only prune: their words are
   counted, and those of two records or more are kept, with a home (the least record that
   has the word, and the least part of a text that it stands in). A bitmap of bounded size
   over the kept words is broadcast.
2. The records are read again, and the letters around anchors of the bitmap, as far as a
   stretch with the anchor reaches, are cut out. What overlaps is one region; longer ones
   become tiles that overlap by ``min_len`` less one. A region goes to the homes of its
   words, so any shared stretch meets its copies there, and neighbouring words, which
   mostly have the same home, travel once.
3. The different texts of a home are the reference, in shards of bounded size. For each
   shard a generalised suffix automaton is built whose states know the least and the
   greatest record that holds their words; all regions of its homes are streamed through,
   and their matching statistics against *other* records give the maximal spans. A home
   with many different texts has several shards, and its regions go through each of them,
   in as many tasks as they need.

A shard is sent to the regions that can match it instead of being broadcast to all documents:
a broadcast of all shards would grow with the data, and so would the passes over them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.runtime import cut

#: Letters of an anchor, at most.
ANCHOR = 24
#: Letters of a tile, at least.
TILE = 1024
#: Letters of the reference of a shard, about.
SHARD = 1 << 18
#: Letters of a text that share a home.
PART = 4096
#: Bits of the bitmap, at most.
MOST_BITS = 1 << 27
#: Letters that are looked at in one go.
CHUNK = 1 << 20
#: Letters of a stretch, at most: places in what is looked at in one go have a fixed number of bits.
MOST_LEN = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
#: Regions that are streamed side by side.
LANES = 8192

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_LETTER = np.frombuffer(b"ACGTN", dtype=np.uint8)
_NO_MOVES = array("i", [-1] * 4)


def _words(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` letters (32 at most) from each place on as one number; letters beyond the end count as 0."""
    out = codes.astype(np.uint64)
    out[out > 3] = 0
    for n in (1, 2, 4, 8, 16):
        out <<= np.uint64(2 * n)
        out[:-n] |= out[n:] >> np.uint64(2 * n)
    return out >> np.uint64(64 - 2 * size)


def _mixed(words: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling, so that simple words aren't always the smallest."""
    x = words ^ (words >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors_of(codes: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scrambled words of the smallest anchor of each stretch of ``min_len`` plain letters."""
    size = min(ANCHOR, min_len)
    reach = min_len - size + 1
    n = len(codes) - min_len + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    plain = np.flatnonzero(bad[min_len:] == bad[:-min_len])
    rank = _mixed(_words(codes, size))[: len(codes) - size + 1]
    # The upper bits of the rank, then the place: the least is the leftmost of those that the upper bits don't tell apart.
    best = rank & ~_PLACE | np.arange(len(rank), dtype=np.uint64)
    span = 1
    while span < reach:  # doubles the reach of the minimum; the last step overlaps
        step = min(span, reach - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    picked = best[plain]
    picked = picked[np.append(True, picked[1:] != picked[:-1])] if len(picked) else picked
    at = (picked & _PLACE).astype(np.int64)
    return at, rank[at].view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Record ids, letter codes and ends of some texts of a batch, one after the other with a stop between them."""
    ids, texts, first = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), 0
    while first < len(ids):
        parts, bounds, last = [b"\n"], [1], first
        while last < len(ids) and (last == first or bounds[-1] < CHUNK):
            parts.append(texts[last].as_py().encode("ascii", "replace") + b"\n")
            bounds.append(bounds[-1] + len(parts[-1]))
            last += 1
        yield ids[first:last], _CODE[np.frombuffer(b"".join(parts), dtype=np.uint8)], np.array(bounds)
        first = last


def _anchored(batch: pa.RecordBatch, min_len: int):
    """Ids, codes, bounds, anchor places and words of some texts; a single long text is looked at in overlapping parts."""
    for ids, codes, bounds in _texts(batch):
        for begin in range(0, len(codes), CHUNK):
            lo, hi = max(0, begin - min_len), min(len(codes), begin + CHUNK + min_len)
            at, word = anchors_of(codes[lo:hi], min_len)
            at = at + lo
            inside = (at >= begin) & (at < begin + CHUNK)
            if inside.any():
                yield ids, codes, bounds, at[inside], word[inside]


def _words_of(min_len: int):
    """Task function: word, record and part of the text of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, bounds, at, word in _anchored(batch, min_len):
                row = np.searchsorted(bounds, at, side="right") - 1
                part = ((at - bounds[row]) // PART).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(ids[row]), pa.array(part)], names=["word", "ref_id", "part"])

    return run


def _regions(min_len: int, bitmap):
    """Task function: the regions around anchors whose words the bitmap has, with these words."""
    size = min(ANCHOR, min_len)
    flank, tile = min_len - size, max(TILE, 4 * min_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = np.int64(len(bits) * 64 - 1)
        for batch in batches:
            for ids, codes, bounds, at, word in _anchored(batch, min_len):
                low = word & mask
                known = (bits[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1
                at, word = at[known], word[known]
                if not len(at):
                    continue
                stops = np.flatnonzero(codes > 3)
                j = np.searchsorted(stops, at)
                begin, end = np.maximum(at - flank, stops[j - 1] + 1), np.minimum(at + size + flank, stops[j])
                first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                begin, end = begin[first], end[np.append(first[1:], len(end)) - 1]
                step = tile - min_len + 1
                many = np.maximum(1, -(-(end - begin - min_len + 1) // step))
                begin = np.repeat(begin, many) + step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                end = np.minimum(begin + tile, np.repeat(end, many))
                i0, i1 = np.searchsorted(at, begin), np.searchsorted(at, end - size, side="right")
                full = (i1 > i0) & (end - begin >= min_len)
                begin, end, i0, i1 = begin[full], end[full], i0[full], i1[full]
                if not len(begin):
                    continue
                row = np.searchsorted(bounds, begin, side="right") - 1
                words = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(i1 - i0)).astype(np.int32)), pa.array(np.concatenate([word[a:b] for a, b in zip(i0, i1)]))
                )
                texts = pa.array([_LETTER[codes[a:b]].tobytes() for a, b in zip(begin, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(begin - bounds[row]), texts, words], names=["ref_id", "start", "text", "words"])

    return run


class Automaton:
    """Suffix automaton of many words over four letters; states know the least and greatest owner of their words.

    Words are added one by one; ``close`` turns the automaton into arrays that regions are streamed through.
    """

    def __init__(self):
        self.next = array("i", _NO_MOVES)  # four for each state
        self.link = [-1]
        self.length = [0]
        self.least = [2**63 - 1]
        self.most = [-(2**63)]

    def _split(self, p, c, q):
        """A state for the words of q that are no longer than those of p followed by c."""
        nxt, link = self.next, self.link
        nxt.extend(nxt[4 * q : 4 * q + 4])
        self.length.append(self.length[p] + 1)
        self.least.append(2**63 - 1)
        self.most.append(-(2**63))
        r = len(link)
        link.append(link[q])
        link[q] = r
        while p >= 0 and nxt[4 * p + c] == q:
            nxt[4 * p + c] = r
            p = link[p]
        return r

    def add(self, word: bytes, least: int, most: int) -> None:
        """Adds a word of letters 0 to 3."""
        nxt, link, length, low, high = self.next, self.link, self.length, self.least, self.most
        last = 0
        for c in word:
            at = 4 * last + c
            q = nxt[at]
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                if least < low[last]:
                    low[last] = least
                if most > high[last]:
                    high[last] = most
                continue
            new = len(link)
            nxt.extend(_NO_MOVES)
            nxt[at] = new
            length.append(length[last] + 1)
            low.append(least)
            high.append(most)
            link.append(0)
            p = link[last]
            while p >= 0:
                at = 4 * p + c
                q = nxt[at]
                if q >= 0:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                    break
                nxt[at] = new
                p = link[p]
            last = new

    def close(self) -> None:
        """Hands owners on to the suffixes, and finds for each state of one owner its longest suffix of several."""
        n = len(self.link)  # one more state, before the root: every letter leads from it to the root
        self.next = np.concatenate([np.frombuffer(self.next, dtype=np.int32), np.zeros(4, dtype=np.int32)])
        self.link = np.array([*self.link, n], dtype=np.int32)
        self.link[0] = n
        self.length = np.array([*self.length, -1], dtype=np.int32)
        self.least = np.array([*self.least, 2**63 - 1], dtype=np.int64)
        self.most = np.array([*self.most, -(2**63)], dtype=np.int64)
        order = np.argsort(-self.length[:n], kind="stable")
        levels = np.flatnonzero(np.append(True, np.diff(self.length[order]) != 0))
        for a, b in zip(levels, np.append(levels[1:], n)):
            at = order[a:b]
            if at[0]:
                np.minimum.at(self.least, self.link[at], self.least[at])
                np.maximum.at(self.most, self.link[at], self.most[at])
        self.far = np.where(self.least == self.most, self.link, np.arange(n + 1, dtype=np.int32))
        while True:
            farther = self.far[self.far]
            if (farther == self.far).all():
                break
            self.far = farther

    def spans(self, texts: np.ndarray, offset: np.ndarray, length: np.ndarray, owner: np.ndarray, min_len: int):
        """Lane, begin and end of the maximal unions of the stretches of at least ``min_len`` letters that others than the lane's owner hold too.

        ``texts`` holds letters 0 to 3; the lanes, longest first, begin at ``offset``. All lanes go on by one letter at a time.
        """
        state, seen = np.zeros(len(offset), dtype=np.int32), np.zeros(len(offset), dtype=np.int32)
        begin, end = np.zeros(len(offset), dtype=np.int64), np.full(len(offset), -1, dtype=np.int64)
        out = []
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t, side="left"))  # lanes of more than t letters
            v, c = state[:k], texts[offset[:k] + t]
            to = self.next[v * 4 + c]
            lost = np.flatnonzero(to < 0)
            while len(lost):
                v[lost] = self.link[v[lost]]
                seen[lost] = self.length[v[lost]]
                to[lost] = self.next[v[lost] * 4 + c[lost]]
                lost = lost[to[lost] < 0]
            state[:k] = to
            seen[:k] += 1
            if t + 1 < min_len:
                continue
            own = (self.least[to] == owner[:k]) & (self.most[to] == owner[:k])
            n = np.where(own, self.length[self.far[to]], seen[:k])
            hit = np.flatnonzero(n >= min_len)
            if len(hit):
                start = t + 1 - n[hit]
                new = start > end[hit]
                done = hit[new & (end[hit] >= 0)]
                out.append((done, begin[done], end[done]))
                begin[hit] = np.where(new, start, np.minimum(begin[hit], start))
                end[hit] = t + 1
        done = np.flatnonzero(end >= 0)
        out.append((done, begin[done], end[done]))
        return [np.concatenate(x) for x in zip(*out)]


class _Shard:
    """References and waiting regions of one or more homes."""

    def __init__(self, min_len: int):
        self.min_len, self.automaton, self.closed = min_len, Automaton(), False
        self.letters = self.waiting = 0
        self.regions: list[tuple[int, int, bytes]] = []

    def add(self, text: bytes, least: int, most: int) -> None:
        self.automaton.add(_CODE[np.frombuffer(text, dtype=np.uint8)].tobytes(), least, most)
        self.letters += len(text)

    def wait(self, owner: int, start: int, text: bytes) -> None:
        self.regions.append((owner, start, text))
        self.waiting += len(text)

    def stream(self) -> Iterator[pa.RecordBatch]:
        """Spans of the waiting regions."""
        if not self.closed:
            self.automaton.close()
            self.closed = True
        self.regions.sort(key=lambda r: -len(r[2]))
        for first in range(0, len(self.regions), LANES):
            owners, starts, texts = zip(*self.regions[first : first + LANES])
            owners, starts, length = np.array(owners), np.array(starts), np.array([len(x) for x in texts])
            codes = _CODE[np.frombuffer(b"".join(texts), dtype=np.uint8)]
            lane, a, b = self.automaton.spans(codes, np.cumsum(length) - length, length, owners, self.min_len)
            yield pa.RecordBatch.from_arrays([pa.array(owners[lane]), pa.array(starts[lane] + a), pa.array(starts[lane] + b)], names=["ref_id", "s", "e"])
        self.regions, self.waiting = [], 0


def _matched(min_len: int, shard: int):
    """Task function: spans of a partition that is sorted by home and shard, each with its references first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = _Shard(min_len), None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *home, kind, least, most, start, text in zip(*cols):
                if home != last:
                    if now.closed or now.letters >= shard:
                        yield from now.stream()
                        now = _Shard(min_len)
                    last = home
                if kind:
                    now.wait(least, start, text)
                    if now.waiting >= 16 * shard:
                        yield from now.stream()
                else:
                    now.add(text, least, most)
        yield from now.stream()

    return run


def _bitmap(shared: DataFrame):
    """Bits at the low ends of the words; its size follows from their number up to ``MOST_BITS``."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (16 * shared.count()).bit_length()))
    low = F.col("word").bitwiseAND(bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(63).cast("int"))
    rows = shared.select(F.shiftright(low, 6).alias("i"), one.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return shared.sparkSession.sparkContext.broadcast(out)


def shared_spans(df: DataFrame, record: str, text: str, min_len: int = 64, shard: int = SHARD) -> DataFrame:
    """``ref_id``, ``span_start``, ``span_end``: the longest runs of shared letters of each record.

    A letter is shared if it lies in a stretch of at least ``min_len`` (1 to ``MOST_LEN``) of
    A, C, G, T in either case that also stands in another record, on the same strand.
    Start is 0-based, end exclusive; runs that touch are one. Rows with the same
    record id are the same record; null ids, null and short texts have no spans. An
    empty table gives an empty result. Other columns are left out.
    """
    if not 1 <= min_len <= MOST_LEN:
        raise ValueError(f"min_len must lie in 1 to {MOST_LEN}")
    spark = df.sparkSession
    rows = df.filter(F.col(record).isNotNull() & (F.length(text) >= min_len)).select(F.col(record).cast("bigint").alias("ref_id"), F.col(text).alias("text"))
    words = rows.mapInArrow(_words_of(min_len), "word bigint, ref_id bigint, part int")
    owners = words.groupBy("word").agg(F.min("ref_id").alias("x"), F.max("ref_id").alias("y"), F.min("part").alias("part"))
    shared = cut(owners.filter("x < y").select("word", "x", "part"))
    regions = rows.mapInArrow(_regions(min_len, _bitmap(shared)), "ref_id bigint, start bigint, text binary, words array<bigint>")
    regions = cut(regions.withColumn("region", F.monotonically_increasing_id()))
    homes = regions.select("region", F.explode("words").alias("word")).join(shared, "word").select("region", "x", "part").distinct()
    routed = regions.join(homes, "region").select("x", "part", "ref_id", "start", "text")
    texts = routed.groupBy("x", "part", "text").agg(F.min("ref_id").alias("least"), F.max("ref_id").alias("most"), F.count("*").alias("copies"))
    # Shards of a home, and tasks for its regions with each of them.
    n = F.octet_length("text")
    sizes = texts.groupBy("x", "part").agg(F.ceil(F.sum(n) / shard).cast("int").alias("shards"), F.ceil(F.sum(n * F.col("copies")) / (64 * shard)).cast("int").alias("tasks"))
    sizes = sizes.filter("shards > 1 or tasks > 1")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    one = lambda c, *by: F.pmod(F.xxhash64(*by), F.coalesce(c, F.lit(1))).cast("int")
    references = (
        texts.join(sizes, ["x", "part"], "left")
        .select("x", "part", one("shards", "text").alias("shard"), every("tasks").alias("task"), F.lit(0).alias("kind"), "least", "most", F.lit(None).cast("bigint").alias("start"), "text")
    )
    streamed = (
        routed.join(sizes, ["x", "part"], "left")
        .select("x", "part", every("shards").alias("shard"), one("tasks", "ref_id", "start").alias("task"), F.lit(1).alias("kind"), F.col("ref_id").alias("least"), F.col("ref_id").alias("most"), "start", "text")
    )
    letters = regions.agg(F.sum(n)).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-letters // (8 * shard)))
    found = (
        references.unionByName(streamed)
        .repartition(partitions, "x", "part", "shard", "task")
        .sortWithinPartitions("x", "part", "shard", "task", "kind")
        .mapInArrow(_matched(min_len, shard), "ref_id bigint, s bigint, e bigint")
        .groupBy("ref_id", "s")
        .agg(F.max("e").alias("e"))
    )
    order = Window.partitionBy("ref_id").orderBy("s")
    starts = F.col("s") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = found.withColumn("new", starts.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ref_id", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select("ref_id", "span_start", "span_end")
