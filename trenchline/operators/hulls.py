"""Convex outline of a project's design, in two distributed phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "project_id string, lon double, lat double"


def _chain(points: np.ndarray) -> list[int]:
    """One side of the hull of points sorted by x then y: indices that always turn left."""
    keep: list[int] = []
    for i, p in enumerate(points):
        while len(keep) > 1:
            a, b = points[keep[-2]], points[keep[-1]]
            if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                break
            keep.pop()
        keep.append(i)
    return keep


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices of (x, y) points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    back = pts[::-1]
    return np.vstack([pts[_chain(pts)][:-1], back[_chain(back)][:-1]])


def _outline(pdf: pd.DataFrame, project: str) -> pd.DataFrame:
    h = hull(pdf[["lon", "lat"]].to_numpy())
    return pd.DataFrame({"project_id": project, "lon": h[:, 0], "lat": h[:, 1]})


def _local_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.concat([_outline(g, str(k)) for k, g in pdf.groupby("project_id")])


def design_outline(vertices: DataFrame, salts: int = 64) -> DataFrame:
    """Hull vertices per project, in order, with the closing point repeated.

    Batches keep only their own hull, then (project, salt) groups do, then projects:
    a project of any size reaches its last task as at most `salts` small hulls.  The salt follows
    the partition a hull was made in, so a project that lies in one place makes one group.
    """
    near = vertices.select("project_id", "lon", "lat").mapInPandas(_local_hulls, _SCHEMA)
    salted = near.withColumn("salt", F.spark_partition_id() % salts)
    def of_salt(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _outline(g, key[0])

    mid = salted.groupBy("project_id", "salt").applyInPandas(of_salt, _SCHEMA)

    def closed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = _outline(g, key[0])
        if len(out) < 3:
            out = out.iloc[0:0]
        else:
            out = pd.concat([out, out.iloc[:1]], ignore_index=True)
        return out.assign(pos=np.arange(len(out), dtype="int32"))

    return mid.groupBy("project_id").applyInPandas(closed, _SCHEMA + ", pos int")
