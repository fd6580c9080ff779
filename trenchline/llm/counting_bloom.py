"""A counting Bloom sketch as a table: one row of counters for each segment of the hash space.

Every hash has its `HASHES` counters in one segment, and the number of segments follows the
number of hashes, so the sketch keeps its error rate at any size and no task holds more than
the segment it works on.  Tasks count what they see; the sums are merged segment by segment.
A hash one of whose counters is 1 occurs once, for certain.  Rows meet their segment in a
join: Spark broadcasts the sketch while it is small and deals both by segment beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3
SLOTS = 4096  # counters of a segment
SLOTS_PER_HASH = 16
#: Hashes that a task counts before it hands the counters on.
HELD_HASHES = 1 << 18
MOST = 255
_SHIFTS = (0, 12, 24)  # bits of the hash that choose the slots; those above 2**36 choose the segment


def segments_for(n: int) -> int:
    return -(-max(1, n) * SLOTS_PER_HASH // SLOTS)


def segment_of(h: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 36), F.lit(segments)).cast("int")


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(s)).astype(np.int64) & (SLOTS - 1) for s in _SHIFTS]


def counted(hashes: np.ndarray, segments: int) -> pa.RecordBatch:
    """segment, slots, times: the counters that these hashes raise, one row a segment."""
    h = hashes.astype(np.uint64)
    segment = ((h >> np.uint64(36)) % np.uint64(segments)).astype(np.int64)
    slots = np.sort(np.stack(slots_of(h)), axis=0)
    # two slots of one hash may be the same one, which is then raised once
    fresh = np.ones(slots.shape, bool)
    fresh[1:] = slots[1:] != slots[:-1]
    at, times = np.unique((segment + np.zeros_like(slots))[fresh] * SLOTS + slots[fresh], return_counts=True)
    own, start = np.unique(at // SLOTS, return_index=True)
    offsets = pa.array(np.append(start, len(at)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array((at % SLOTS).astype(np.int16))),
         pa.ListArray.from_arrays(offsets, pa.array(np.minimum(times, MOST).astype(np.int16)))],
        ["segment", "slots", "times"])


def sketch(hashed: DataFrame, segments: int) -> DataFrame:
    """segment and its counters, one byte each; `hashed` has one column of 64-bit hashes."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= HELD_HASHES:
                yield counted(np.concatenate(held), segments)
                held, n = [], 0
        if n:
            yield counted(np.concatenate(held), segments)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(SLOTS, np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(counters, MOST).astype(np.uint8).tobytes()], pa.binary())], ["segment", "counters"])

        for batch in batches:
            for segment, slots, times in zip(batch["segment"].to_pylist(), batch["slots"], batch["times"], strict=True):
                if segment != now:
                    if now is not None:
                        yield row()
                    now, counters = segment, np.zeros(SLOTS, np.int64)
                counters[slots.values.to_numpy()] += times.values.to_numpy()
        if now is not None:
            yield row()

    partial = hashed.mapInArrow(count, "segment int, slots array<short>, times array<short>")
    return partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, counters binary")


def may_repeat(h: Column, counters: Column) -> Column:
    """False for a hash that certainly occurs once."""
    out = F.lit(True)
    for s in _SHIFTS:
        slot = (F.shiftrightunsigned(h, s).bitwiseAND(SLOTS - 1) + 1).cast("int")
        out = out & (F.substring(counters, slot, F.lit(1)) > F.lit(b"\x01"))
    return out


def possible_repeats(rows: DataFrame, n: int, h: str = "h") -> DataFrame:
    """The rows of `rows` (about `n`) whose hash may occur more than once."""
    segments = segments_for(n)
    counters = sketch(rows.select(h), segments)
    met = rows.withColumn("segment", segment_of(F.col(h), segments)).join(counters, "segment")
    return met.where(may_repeat(F.col(h), F.col("counters"))).drop("segment", "counters")
