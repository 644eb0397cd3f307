"""Byte-pair encoding with a public rank vocabulary, merges found by a segment tree.

A text is split by the vocabulary's pattern; each part is merged on its own. The
leaves of a segment tree hold the ranks of the part's adjacent pairs, inner nodes the
least (rank, place) below them, so the root is the leftmost pair of lowest rank. A
merge changes three leaves, each in logarithmic time, until no pair can be merged;
a part of n bytes costs O(n log n) however long it is.

The vocabulary file is read on the driver and broadcast (its size is checked); each
Python worker parses it once and remembers the ids of parts it has met, up to a bound.
"""

from __future__ import annotations

import base64
import importlib.util
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that splits a text before the merges of the byte_bpe rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary file that is broadcast, in bytes.
MOST_BYTES = 64 << 20
#: Parts that a worker remembers, and the longest of them in letters.
MOST_PARTS, LONGEST_PART = 200_000, 48


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file: in ``TOKENIZER_DIR`` if set, else in the installed folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


class Encoder:
    """Ids of texts by a rank file."""

    def __init__(self, data: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in data.splitlines():
            if line:
                word, rank = line.split()
                self.ranks[base64.b64decode(word)] = int(rank)
        self.split = regex.compile(SPLIT).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part."""
        ranks = self.ranks
        whole = ranks.get(part)
        if whole is not None:
            return [whole]
        n = len(part)
        words: list[bytes | None] = [part[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(1, (n - 1).bit_length())
        none = (1 << 62) * size
        tree = [none] * (2 * size)

        def key(i: int) -> int:  # a pair's rank, then its place
            j = after[i]
            rank = ranks.get(words[i] + words[j]) if j < n else None
            return none if rank is None else rank * size + i

        for i in range(n - 1):
            tree[size + i] = key(i)
        for v in range(size - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(i: int, value: int) -> None:
            v = size + i
            tree[v] = value
            while v > 1:
                other = tree[v ^ 1]
                v >>= 1
                least = value if value <= other else other
                if tree[v] == least:
                    break
                tree[v] = value = least

        while tree[1] < none:
            i = tree[1] % size
            j = after[i]
            words[i] += words[j]
            words[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, key(i))
            if before[i] >= 0:
                put(before[i], key(before[i]))
        return [ranks[w] for w in words if w is not None]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                ids = tuple(self.merge(part.encode("utf-8", "surrogatepass")))
                if len(part) <= LONGEST_PART:
                    if len(known) >= MOST_PARTS:
                        known.clear()
                    known[part] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


class _Shared:
    """A broadcast vocabulary that a worker turns into an encoder once."""

    def __init__(self, spark: SparkSession, path: str):
        size = os.path.getsize(path)
        if size > MOST_BYTES:
            raise ValueError(f"{path} has {size} bytes; at most {MOST_BYTES} are broadcast")
        with open(path, "rb") as file:
            self.data = spark.sparkContext.broadcast(file.read())
        self.name = f"{path}:{size}:{os.path.getmtime(path)}"

    def encoder(self) -> Encoder:
        if self.name not in _ENCODERS:
            _ENCODERS[self.name] = Encoder(self.data.value)
        return _ENCODERS[self.name]


def token_ids(spark: SparkSession, text: str | Column, path: str | None = None) -> Column:
    """Ids of a text without special tokens, as an array of int; the empty list for an empty or null text.

    The strings of special tokens in a text are ordinary text.
    """
    shared = _Shared(spark, path or vocabulary_path())

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = shared.encoder().encode
        lists = [np.array(encode(x), dtype=np.int32) if x else np.zeros(0, np.int32) for x in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return ids(F.col(text) if isinstance(text, str) else text)


def token_count(spark: SparkSession, text: str | Column, path: str | None = None) -> Column:
    """Number of tokens of a text; 0 for an empty or null text."""
    shared = _Shared(spark, path or vocabulary_path())

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = shared.encoder().encode
        return pa.array([len(encode(x)) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)
