"""Stretches of polylines, cut many at a time.

`geo.clip` as one vectorised call a batch.  The same arithmetic, so the same points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from trenchline.functions.geo import SAME_DEG
from trenchline.operators.windows import flat

POINTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each stretch."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


@arrow_udf(POINTS)
def clip(coords: pa.Array, chain: pa.Array, start_ft: pa.Array, end_ft: pa.Array) -> pa.Array:
    """`geo.clip`: exact ends, the vertices strictly between; empty when reversed; null without a line.

    A distance that is null or not a number stands for the end of the line.
    """
    feet, first, size = flat(chain)
    points, at, _ = flat_points(coords)
    given = coords.is_valid().to_numpy(zero_copy_only=False) & chain.is_valid().to_numpy(zero_copy_only=False)
    s = start_ft.to_numpy(zero_copy_only=False).astype(float)
    e = end_ft.to_numpy(zero_copy_only=False).astype(float)
    n = len(s)
    total = np.zeros(n)
    total[size > 0] = feet[(first + size - 1)[size > 0]]
    s, e = np.maximum(np.fmin(s, total), 0.0), np.maximum(np.fmin(e, total), 0.0)
    live = given & (e > s) & (size >= 2)
    of = np.repeat(np.arange(n), size)
    vertex = feet[_spread(first, size)]

    def counted(hit: np.ndarray) -> np.ndarray:
        """Vertices of each row that pass a test."""
        return np.bincount(of[hit], minlength=n)

    below, above, upto = counted(vertex < s[of]), counted(vertex <= s[of]), counted(vertex < e[of])

    def end_point(row: np.ndarray, count: np.ndarray, t: np.ndarray) -> np.ndarray:
        seg = np.minimum(np.maximum(count[row], 1), size[row] - 1)
        a, b = feet[first[row] + seg - 1], feet[first[row] + seg]
        ratio = np.minimum(np.maximum((t[row] - a) / np.maximum(b - a, 1e-9), 0.0), 1.0)
        p, q = points[at[row] + seg - 1], points[at[row] + seg]
        return p + (q - p) * ratio[:, None]

    rows = np.flatnonzero(live)
    between = np.maximum(upto[rows] - above[rows], 0)
    count = between + 2
    offset = np.cumsum(count) - count
    out = np.empty((int(count.sum()), 2))
    out[offset], out[offset + count - 1] = end_point(rows, below, s), end_point(rows, upto, e)
    out[_spread(offset + 1, between)] = points[_spread(at[rows] + above[rows], between)]
    # a point that repeats the one before it goes
    keep = np.ones(len(out), bool)
    keep[1:] = ~(np.abs(out[1:] - out[:-1]) <= SAME_DEG).all(axis=1)
    keep[offset] = True
    kept = np.zeros(n, np.int64)
    if len(rows):
        kept[rows] = np.add.reduceat(keep.astype(np.int64), offset)
    offsets = np.concatenate([[0], np.cumsum(kept)])
    values = pa.StructArray.from_arrays([pa.array(out[keep, 0]), pa.array(out[keep, 1])], ["lat", "lon"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~given))


def flat_points(coords: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((lat, lon) rows, first, size) of a column of polylines."""
    offsets = coords.offsets.to_numpy().astype(np.int64)
    return np.stack([coords.values.field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon")], axis=1), offsets[:-1], np.diff(offsets)
