"""Anchor search by projected stations: candidate starts, their profile, the best one.

The other way to place a group: instead of sliding a window, try starts that put a station
on a vertex or a quarter point.  Scored per (group, route) row in one vectorised call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from trenchline.operators.windows import Line, half_up, line_of

_CHUNK = 2000
#: Starts laid out first, to see what score others must reach; routes whose bends are kept.
_FIRST, _ROUTES = 24, 256


def bends(lat: np.ndarray, lon: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feet and degrees of heading changes of at least 12 degrees."""
    heading = np.arctan2(np.diff(lat) * 364000.0, np.diff(lon) * 364000.0 * np.cos(np.radians(lat[0])))
    turn = np.abs(np.degrees(np.diff(heading))) % 360.0
    turn = np.minimum(turn, 360.0 - turn)
    big = turn >= 12.0
    return chain[1:-1][big], turn[big]


def candidate_starts(line: Line, span_ft: float, offsets: np.ndarray, low_ft: float, high_ft: float) -> np.ndarray:
    """Starts worth trying: ends, middle, the absolute place, vertices and quarter points under
    each station, and even steps."""
    usable = max(0.0, min(span_ft, line.total))
    top = max(0.0, line.total - usable)
    probes = np.unique(np.concatenate([[0.0], offsets, [half_up(offsets[-1] / 2.0, 2)] if len(offsets) else [],
                                       [half_up(offsets[len(offsets) // 2], 2)] if len(offsets) >= 3 else []]))
    quarters = (line.chain[:-1, None] + line.step[:, None] * np.array([0.25, 0.5, 0.75])).ravel()
    spots = np.concatenate([line.chain, quarters])
    found = [np.array([0.0, top]), np.clip(spots[:, None] - probes[None, :], 0.0, top).ravel()]
    if top > 0:
        found.append([top / 2.0])
        step = max(8.0, min(25.0, usable / 10.0 if usable > 0 else line.total / 30.0))
        found.append(np.minimum(np.arange(int((top + 1e-9) // step) + 1) * step, top))
    if 0.0 <= low_ft <= line.total and 0.0 <= high_ft <= line.total and high_ft > low_ft:
        found.append([min(low_ft, top)])
    return np.unique(half_up(np.concatenate(found), 2))


def _least_jump(line: Line, offsets: np.ndarray, usable: float) -> int:
    """Pieces that some step between stations goes on by, wherever they lie on the route; 0 if they may be clamped to it."""
    wide = float((line.step / line.pieces).max()) + 0.02
    if offsets.max() > usable + 0.01:
        return 0
    return max(int(offsets[-1] - offsets[0] > wide), int(np.diff(offsets).max(initial=0.0) // wide))


def score_starts(line: Line, turns: tuple[np.ndarray, np.ndarray], span_ft: float, offsets: np.ndarray, low_ft: float, high_ft: float,
                 route_score: float, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Anchor fit, subsection score and combined score of the starts that can be best.

    What the stations add (balance, at most 1) and take away (jumps, at least those that their distances
    force on the widest piece) bounds a score from above; the stations are only laid out for starts
    whose bound reaches the best score of a few.
    """
    total, usable = line.total, max(0.0, min(span_ft, line.total))
    start = np.clip(starts, 0.0, max(0.0, total - usable))
    end = np.minimum(start + usable, total)
    at, strength = turns
    covered = ((at[None, :] >= start[:, None]) & (at[None, :] <= end[:, None])) @ strength if len(at) else np.zeros(len(start))
    density = half_up(np.minimum(1.0, covered / max(35.0, usable * 0.18)), 6) if usable > 0 else np.zeros(len(start))

    def off_vertex(x: np.ndarray) -> np.ndarray:
        after = np.searchsorted(line.chain[:-1], x)
        return np.minimum(np.abs(x - line.chain[np.maximum(after - 1, 0)]), np.abs(x - line.chain[after]))

    align = half_up(np.maximum(0.0, 1.0 - np.minimum(1.0, (off_vertex(start) + off_vertex(end)) / max(30.0, usable * 0.15) / 2.0)), 6)
    clear = half_up(np.minimum(start, np.maximum(0.0, total - end)), 2)
    edge = np.ones(len(start)) if total <= usable + 1.0 else np.minimum(1.0, clear / max(35.0, usable * 0.12))
    absolute = np.zeros(len(start))
    if 0.0 <= low_ft <= total and 0.0 <= high_ft <= total and high_ft > low_ft:
        slack = max(20.0, usable * 0.08)
        absolute = (np.maximum(0.0, 1.0 - np.abs(start - low_ft) / slack) + np.maximum(0.0, 1.0 - np.abs(end - high_ft) / slack)) / 2.0
    both = span_ft > 0 and total > 0
    span_fit = min(span_ft, total) / max(span_ft, total) if both else 1.0
    length_fit = max(0.0, 1.0 - abs(total - span_ft) / max(span_ft, 1.0)) if both else 0.0

    bounds, on_piece, inside = line.inner()

    def scored(of, balance, penalty) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = 0.30 * align[of] + 0.25 * balance + 0.15 * density[of] + 0.15 * edge[of] + 0.15 * absolute[of]
        sub = np.clip(0.35 * span_fit + 0.25 * length_fit + 0.40 * fit - 0.18 * penalty, 0.0, 1.0)
        return fit, sub, half_up(np.clip(0.55 * route_score + 0.45 * sub, 0.0, 1.0), 6)

    def laid_out(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # one row a station, one column a start: reductions run down long rows
        place = np.searchsorted(bounds, np.minimum(offsets[:, None] + start[None, of], total))
        balance = half_up(np.count_nonzero(inside.take(place), axis=0) / len(offsets), 6)
        piece = on_piece.take(place)
        jump = np.abs(piece[1:] - piece[:-1]).max(axis=0) if len(piece) > 1 else np.zeros(len(of))
        return scored(of, balance, half_up(np.minimum(1.0, jump / 3.0), 6))

    can = np.arange(len(start))
    if len(start) > 2 * _FIRST:
        most = scored(can, 1.0, half_up(min(1.0, _least_jump(line, offsets, usable) / 3.0), 6))[2]
        few = np.argpartition(-most, _FIRST)[:_FIRST]
        can = np.flatnonzero(most >= laid_out(few)[2].max())
    fit, sub, combined = laid_out(can)
    return {"start": half_up(start[can], 2), "end": half_up(end[can], 2), "fit": half_up(fit, 6), "sub": half_up(sub, 6), "absolute": absolute[can],
            "combined": combined}


RESULT = T.StructType([
    T.StructField("anchor_start_ft", T.DoubleType()), T.StructField("anchor_end_ft", T.DoubleType()), T.StructField("anchor_fit", T.DoubleType()),
    T.StructField("subsection_score", T.DoubleType()), T.StructField("anchor_combined", T.DoubleType()), T.StructField("anchor_method", T.StringType()),
    T.StructField("n_starts", T.IntegerType()),
])


@pandas_udf(RESULT)
def best_anchor(chain: pd.Series, lat: pd.Series, lon: pd.Series, rel: pd.Series, span: pd.Series, low: pd.Series, high: pd.Series,
                score: pd.Series) -> pd.DataFrame:
    out, lines, turns = [], {}, {}
    for c, la, lo, x, s, a, b, q in zip(chain, lat, lon, rel, span, low, high, score):
        line, offsets = line_of(c, lines), np.asarray(x, dtype=float)
        la, lo = np.asarray(la, dtype=float), np.asarray(lo, dtype=float)
        if (route := (line.chain.tobytes(), la.tobytes(), lo.tobytes())) not in turns:
            if len(turns) >= _ROUTES:
                turns.clear()
            turns[route] = bends(la, lo, line.chain)
        starts = candidate_starts(line, s, offsets, a, b)
        best = None
        for at in range(0, len(starts), _CHUNK):
            got = score_starts(line, turns[route], s, offsets, a, b, q, starts[at:at + _CHUNK])
            k = np.lexsort((got["start"], -got["sub"], -got["combined"]))[0]
            row = (got["start"][k], got["end"][k], got["fit"][k], got["sub"][k], got["combined"][k],
                   "absolute_station_projection" if got["absolute"][k] >= 0.85 else "projection_window_search", len(starts))
            if best is None or (-row[4], -row[3], row[0]) < (-best[4], -best[3], best[0]):
                best = row
        out.append(best)
    return pd.DataFrame(out, columns=RESULT.names)


def search_anchors(inputs: DataFrame) -> DataFrame:
    """Best projected anchor of each (group, route)."""
    usable = inputs.where((F.col("total_ft") > 0) & (F.size("chain") >= 2))
    return usable.withColumn("w", best_anchor("chain", "lats", "lons", "rel", "span_ft", "min_station_ft", "max_station_ft", "score")).select("*", "w.*").drop("w")
