"""Shared pieces of the training-data operators: hashing of words, components of a graph.

Words are maximal runs of bytes other than space and \\x09-\\x0D.  They are hashed
a slice of a batch at a time with numpy, so no Python loop runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iteration import scratch, stored

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

__all__ = ["SPACE", "PLACE", "Words", "components", "documents", "mix", "scratch", "slices", "stored"]

#: Bytes of text that are hashed together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240501)
#: One odd multiplier for each place in a window of words.
PLACE = _rng.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some documents: bytes data[start:end] each, hashes, and of[i]:of[i+1] for document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        solid = ~space[data]
        if lower:
            data = LOWER[data]
        n = len(data)
        first, last = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        if n:
            first[1:] = ~solid[:-1]
            last[:-1] = ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            first[inner] = True
            last[inner - 1] = True
        self.start = np.flatnonzero(solid & first)
        self.end = np.flatnonzero(solid & last) + 1
        self.of = np.searchsorted(self.start, offsets)
        lens = self.end - self.start
        if not len(lens):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        powers = np.full(int(lens.max()), _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.add.reduceat((data[solid].astype(np.uint64) + np.uint64(1)) * powers[place], at)
        self.hash = mix(sums ^ (lens.astype(np.uint64) * PLACE[0]))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k words from each place on; those that cross documents are the caller's to leave out."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * PLACE[j % 64]
        return mix(total)


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES, space: np.ndarray = SPACE):
    """(first row, row after the last, Words) for slices of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a, rows = 0, len(column)
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, rows)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, space)
        a = b


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the least node that edges reach; nodes without an edge have no row.

    Alternating large-star and small-star rounds.  Each keeps only the least
    neighbour of a node, so no neighbour list is ever gathered; each round is
    written to the shared folder.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(rounds):
        # Tables of minima are written, so that either side of a join has a shuffle of its own and a hub's partition can be split.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
