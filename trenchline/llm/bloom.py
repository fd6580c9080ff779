"""Once-seen and twice-seen Bloom filters, built in tasks and merged segment by segment.

Each task keeps two bit maps: bits hit once and bits hit again.  Merging two maps moves bits
that both have seen into the twice-seen map, so a hash that occurs twice anywhere has all its
bits there: the filter never misses a repeat, and a false positive costs a row's shuffle only.

The maps are as large as `bits`, which follows the number of hashes up to `MAX_BITS`; that
is the proven bound of what tasks hold, of what the driver gathers and of what is broadcast.
Beyond some 10**8 hashes the filter fills and lets more rows through to the exact step, which
is distributed and right with any filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_HASH = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
SEGMENT = 1 << 16  # bytes of the map in one row of the merge
HASHES = 2


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << int(BITS_PER_HASH * max(1, n) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each 64-bit hash."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


class BitMaps:
    """Bits seen once and twice by one task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at in positions(hashes, self.bits):
            at, n = np.unique(at, return_counts=True)
            byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
            again = (n > 1) | (self.once[byte] & bit > 0)
            np.bitwise_or.at(self.twice, byte[again], bit[again])
            np.bitwise_or.at(self.once, byte, bit)

    def segments(self) -> Iterator[dict]:
        for start in range(0, len(self.once), SEGMENT):
            once, twice = self.once[start:start + SEGMENT], self.twice[start:start + SEGMENT]
            if once.any():
                yield {"segment": start // SEGMENT, "once": zlib.compress(once.tobytes(), 1), "twice": zlib.compress(twice.tobytes(), 1)}


SEGMENT_SCHEMA = "segment int, once binary, twice binary"


def segment_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


class TwiceFilter(NamedTuple):
    bits: int
    shared: Broadcast

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        """True for every hash that may occur more than once."""
        maps = self.shared.value
        out = np.ones(len(hashes), bool)
        for at in positions(hashes, self.bits):
            out &= maps[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        return out

    def column(self, hashed: Column) -> Column:
        """A boolean column for a column of 64-bit hashes."""
        @F.pandas_udf("boolean")
        def suspected(h):
            import pandas as pd

            return pd.Series(self.hit(h.to_numpy().astype(np.int64)))

        return suspected(hashed)


def merged(segments: DataFrame, bits: int, times: int = 2) -> TwiceFilter:
    """Fold the tasks' maps segment by segment and hand the once- or twice-seen map to all tasks."""
    def fold(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                k = batch["segment"][i].as_py()
                a, b = (np.frombuffer(zlib.decompress(batch[c][i].as_py()), np.uint8) for c in ("once", "twice"))
                if k in once:
                    twice[k] |= b | once[k] & a
                    once[k] |= a
                else:
                    once[k], twice[k] = a.copy(), b.copy()
        for k, b in (twice if times == 2 else once).items():
            if b.any():
                yield segment_batch([{"segment": k, "once": b"", "twice": zlib.compress(b.tobytes(), 1)}])

    spark = segments.sparkSession
    whole = np.zeros(bits // 8, np.uint8)
    for row in segments.repartition("segment").mapInArrow(fold, SEGMENT_SCHEMA).collect():
        part = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
        whole[row.segment * SEGMENT:row.segment * SEGMENT + len(part)] = part
    return TwiceFilter(bits, spark.sparkContext.broadcast(whole))


def twice_seen(hashed: DataFrame, n: int, times: int = 2) -> TwiceFilter:
    """The filter of a one-column table of about `n` 64-bit hashes (nulls count for nothing).

    With `times` of 1 it holds every hash, and is then a plain Bloom filter.
    """
    bits = bits_for(n)

    def build(batches):
        maps = BitMaps(bits)
        for batch in batches:
            maps.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        for row in maps.segments():
            yield segment_batch([row])

    return merged(hashed.mapInArrow(build, SEGMENT_SCHEMA), bits, times)
