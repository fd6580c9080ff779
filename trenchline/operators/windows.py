"""Where on a route a group lies: sliding windows, their scores, the best anchor.

A window score counts the distinct pieces of route its stations fall on.  Exploded to
rows that is groups x routes x windows x stations; as array functions it is a search per
station.  Here each (group, route) row is scored in one vectorised call inside the task
that holds it, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from trenchline.config import Matching
from trenchline.operators.grouping import GROUP

TYPES = ("coarse_window", "fine_window", "origin_window", "tail_window", "mid_window", "vertex_forward", "vertex_backward")
_CELLS = 2_000_000
#: Lines kept in a call, and window lists kept of a line.
_LINES, _SPANS = 256, 32


def half_up(x, digits: int):
    scale = 10.0 ** digits
    return np.floor(np.asarray(x, dtype=float) * scale + 0.5) / scale


class Line:
    """Chainage of one route with its virtual pieces."""

    def __init__(self, chain: np.ndarray):
        self.chain = np.asarray(chain, dtype=float)
        self.total = float(self.chain[-1])
        self.step = self.chain[1:] - self.chain[:-1]
        self.width = np.maximum(self.step, 1e-9)
        self.pieces = np.maximum(1, np.ceil(self.step / 60.0 - 1e-6)).astype(int)
        ends = np.cumsum(self.pieces)
        self.first, self.n_pieces = ends - self.pieces, int(ends[-1])
        self.windows: dict[float, tuple] = {}
        self.facts: dict[float, tuple] = {}
        self.bounds = self._bounds()
        self._inner: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _bounds(self) -> np.ndarray:
        """The last distance of every piece but the last: a distance lies on the piece whose number is that of
        the bounds below it, exactly as `locate` works it out."""
        seg = np.repeat(np.arange(len(self.pieces)), self.pieces)
        k = np.arange(self.n_pieces) - self.first[seg] + 1
        inner = k < self.pieces[seg]
        at, width, n = self.chain[seg], self.width[seg], self.pieces[seg]
        out = self.chain[seg + 1].copy()
        if inner.any():
            i = np.flatnonzero(inner)

            def on_next(x: np.ndarray) -> np.ndarray:
                ratio = np.minimum(np.maximum((x - at[i]) / width[i], 0.0), 1.0)
                return np.minimum(n[i] - 1, (ratio * n[i]).astype(int)) >= k[i]

            b = at[i] + width[i] * k[i] / n[i]
            while (late := on_next(b)).any():
                b = np.where(late, np.nextafter(b, -np.inf), b)
            while (early := ~on_next(up := np.nextafter(b, np.inf))).any():
                b = np.where(early, up, b)
            out[i] = b
        return out[:-1]

    def inner(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, piece, whether inside) of stretches of the route: a distance lies on the stretch whose number is
        that of the bounds below it; inside are those from .08 to .92 of their piece, as worked out from `parts`."""
        if self._inner is None:
            seg = np.repeat(np.arange(len(self.pieces)), self.pieces)
            at, width, n = self.chain[seg], self.width[seg], self.pieces[seg]
            share = (np.arange(self.n_pieces) - self.first[seg]) / n
            ends = np.append(self.bounds, self.total)

            def local(x: np.ndarray) -> np.ndarray:
                return (np.minimum(np.maximum((x - at) / width, 0.0), 1.0) - share) * n

            def last_before(reached, part: float) -> np.ndarray:
                """The last distance of each piece that has not reached a point; its end if none has."""
                some = reached(ends)
                x = np.minimum(at + width * (share + part / n), ends)
                while (late := some & reached(x)).any():
                    x = np.where(late, np.nextafter(x, -np.inf), x)
                while (early := some & ~reached(up := np.nextafter(x, np.inf))).any():
                    x = np.where(early, up, x)
                return np.where(some, x, ends)

            low, high = last_before(lambda x: local(x) >= 0.08, 0.08), last_before(lambda x: local(x) > 0.92, 0.92)
            k = np.arange(self.n_pieces)
            self._inner = np.stack([low, high, ends], axis=1).ravel()[:-1], np.repeat(k, 3), np.tile([False, True, False], self.n_pieces)
        return self._inner

    def piece(self, feet: np.ndarray) -> np.ndarray:
        """Virtual piece of each distance, clamped to the route."""
        return np.searchsorted(self.bounds, np.minimum(feet, self.total), side="left")

    def parts(self, feet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segment of each distance, clamped to the route, share of it, its pieces and the piece of them."""
        d = np.minimum(np.maximum(feet, 0.0), self.total)
        seg = np.searchsorted(self.chain[1:-1], d, side="left")
        ratio = (d - self.chain.take(seg)) / self.width.take(seg)
        ratio = np.minimum(np.maximum(ratio, 0.0, out=ratio), 1.0, out=ratio)
        pieces = self.pieces.take(seg)
        return seg, ratio, pieces, np.minimum(pieces - 1, (ratio * pieces).astype(int))

    def locate(self, feet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, share of it and virtual piece of each distance, clamped to the route."""
        seg, ratio, _, part = self.parts(feet)
        return seg, ratio, self.first.take(seg) + part


def make_windows(line: Line, span_ft: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (start, end, type) windows of the span's width, in generation order."""
    span, total = max(1.0, span_ft), line.total
    if total <= span:
        return np.array([0.0]), np.array([total]), np.array([-1])

    def ladder(step: float) -> np.ndarray:
        return np.arange(int((total - span + 1e-6) // step) + 1) * step

    coarse, fine = ladder(max(10.0, min(40.0, span / 8.0))), ladder(max(5.0, min(20.0, span / 16.0)))
    mid = (total - span) / 2.0
    pairs = np.empty(2 * len(line.chain))
    pairs[0::2], pairs[1::2] = line.chain, line.chain - span
    kinds = np.concatenate([np.full(len(coarse), 0), np.full(len(fine), 1), [2, 3, 4], np.tile([5, 6], len(line.chain))])
    lows = np.concatenate([coarse, fine, [0.0, total - span, mid], pairs])
    highs = lows + span
    highs[kinds == 3] = total
    highs[kinds == 6] = line.chain
    start = np.clip(lows, 0.0, total)
    end = np.maximum(start, np.minimum(highs, total))
    start, end = half_up(start, 2), half_up(end, 2)
    order = np.lexsort((kinds, end, start))
    s, e, k = start[order], end[order], kinds[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (k[1:] != k[:-1])])
    keep = np.sort(order[new])
    return start[keep], end[keep], kinds[keep]


def hits(line: Line, rel: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many pieces the stations of each window fall on, counted along the stations."""
    hit = np.empty(len(start))
    rows = max(1, _CELLS // max(1, len(rel)))
    for at in range(0, len(start), rows):
        piece = line.piece(rel[:, None] + start[None, at:at + rows])
        hit[at:at + rows] = 1 + np.count_nonzero(piece[1:] != piece[:-1], axis=0)
    return hit


def _span_facts(line: Line, span_ft: float, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Parts of a window's score that the stations do not enter: span fit, distance from the route ends, shape."""
    span = max(1.0, span_ft)
    fit = np.maximum(0.0, 1.0 - np.abs(np.maximum(0.0, end - start) - span) / span)
    edge = np.minimum(1.0, np.minimum(start, np.maximum(0.0, line.total - end)) / span)
    return fit * 0.6, edge * 0.12, 0.08 if len(line.chain) >= 4 else 0.0


def _score(line: Line, facts: tuple, hit) -> np.ndarray:
    fit, edge, shape = facts
    return half_up(np.clip(fit + np.minimum(1.0, hit / max(1, line.n_pieces)) * 0.2 + edge + shape, 0.0, 1.0), 6)


def score_windows(line: Line, rel: np.ndarray, span_ft: float, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Span fit .6, share of the route's pieces hit .2, distance from the route ends .12, shape .08."""
    return _score(line, _span_facts(line, span_ft, start, end), hits(line, rel, start))


def sheet_fractions(sheets, route_sheets) -> np.ndarray:
    """Where along a route a group's sheets lie: share of the nearest sheet's place, .5 for one sheet."""
    if sheets is None or route_sheets is None or len(sheets) == 0 or len(route_sheets) == 0:
        return np.empty(0)
    if len(route_sheets) == 1:
        return np.array([0.5])
    away = np.abs(np.asarray(route_sheets)[None, :] - np.asarray(sheets)[:, None])
    return away.argmin(axis=1) / (len(route_sheets) - 1)


def sheet_bias(line: Line, fractions: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Up to .12 for a window centred where the group's print sheets lie on the route."""
    if fractions is None or len(fractions) == 0 or line.total <= 0:
        return np.zeros(len(start))
    centre = np.clip((start + end) / 2.0, 0.0, line.total) / max(line.total, 1.0)
    away = np.abs(centre[:, None] - np.asarray(fractions, dtype=float)[None, :]).min(axis=1)
    return half_up(np.maximum(0.0, 1.0 - away / 0.18) * 0.12, 6)


def line_of(chain, lines: dict[bytes, Line]) -> Line:
    """The line of a chainage, made once for the rows of one batch that share a route."""
    key = np.asarray(chain, dtype=float).tobytes()
    if key not in lines:
        if len(lines) >= _LINES:
            lines.clear()
        lines[key] = Line(chain)
    return lines[key]


def windows_of(line: Line, span_ft: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`make_windows`, once for each line and span."""
    if span_ft not in line.windows:
        if len(line.windows) >= _SPANS:
            line.windows.clear()
        line.windows[span_ft] = make_windows(line, span_ft)
    return line.windows[span_ft]


def facts_of(line: Line, span_ft: float) -> tuple:
    """`_span_facts` of all windows of a span, and their biases by sheets, once for each line and span."""
    if span_ft not in line.facts:
        if len(line.facts) >= _SPANS:
            line.facts.clear()
        start, end, _ = windows_of(line, span_ft)
        line.facts[span_ft] = (_span_facts(line, span_ft, start, end), {})
    return line.facts[span_ft]


def bias_of(line: Line, span_ft: float, fractions: np.ndarray) -> np.ndarray:
    """`sheet_bias` of all windows of a span."""
    _, known = facts_of(line, span_ft)
    key = np.asarray(fractions, dtype=float).tobytes()
    if key not in known:
        if len(known) >= _SPANS:
            known.clear()
        start, end, _ = windows_of(line, span_ft)
        known[key] = sheet_bias(line, fractions, start, end)
    return known[key]


def scored_windows(chain, rel, span_ft, fractions, lines: dict[bytes, Line] | None = None):
    """Start, end, type, score and bias of every window of one group on one route.

    `lines` keeps lines and their windows between calls.
    """
    line = line_of(chain, {} if lines is None else lines)
    start, end, kind = windows_of(line, span_ft)
    bias = bias_of(line, span_ft, fractions)
    base = _score(line, facts_of(line, span_ft)[0], hits(line, np.asarray(rel, dtype=float), start))
    return line, start, end, kind, half_up(np.clip(base + bias, 0.0, 1.0), 6), bias


def _hits_of(line: Line, rel: np.ndarray, first: np.ndarray, size: np.ndarray, who: np.ndarray, start: np.ndarray) -> np.ndarray:
    """`hits` of single windows: `who` tells the group of each, whose stations are a stretch of `rel`."""
    n = size[who]
    out = np.empty(len(who))
    for part in np.array_split(np.arange(len(who)), 1 + int(n.sum()) // _CELLS):
        m = n[part]
        ends = np.cumsum(m)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[who[part]] - (ends - m), m)
        piece = line.piece(rel[at] + np.repeat(start[part], m))
        new = np.empty(len(piece))
        new[1:] = piece[1:] != piece[:-1]
        new[ends - m] = 1.0
        out[part] = np.add.reduceat(new, ends - m) if len(new) else new
    return out


def leading_windows(line: Line, span_ft: float, rel: np.ndarray, first: np.ndarray, size: np.ndarray, biases: np.ndarray,
                    among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(group, window, score, bias) of the windows that can have the highest score of their group.

    For groups of one span on one route; a group's stations are `size` values of `rel` from `first`, its
    biases a row of `biases`.  A window hits no more pieces than the group has stations or the route has
    pieces.  That bounds its score from above; only windows whose bound reaches the score of the one with
    the highest bound need their stations.  All windows of a group's highest score are among them.
    `among` leaves out windows that a group may not take; each group has one that it may.
    """
    start = windows_of(line, span_ft)[0]
    fit, edge, shape = facts_of(line, span_ft)[0]

    def total(i, j, hit) -> np.ndarray:
        return half_up(np.clip(_score(line, (fit[j], edge[j], shape), hit) + biases[i, j], 0.0, 1.0), 6)

    most = total(slice(None), slice(None), np.minimum(np.maximum(1, size), line.n_pieces)[:, None].astype(float))
    if among is not None:
        most[~among] = -1.0
    each, top = np.arange(len(size)), most.argmax(axis=1)
    least = total(each, top, _hits_of(line, rel, first, size, each, start[top]))
    i, j = np.nonzero(most >= least[:, None])
    return i, j, total(i, j, _hits_of(line, rel, first, size, i, start[j])), biases[i, j]


ANCHOR = T.StructType([
    T.StructField("start_ft", T.DoubleType()), T.StructField("end_ft", T.DoubleType()),
    T.StructField("window_type", T.StringType()), T.StructField("window_score", T.DoubleType()),
    T.StructField("bias", T.DoubleType()), T.StructField("n_windows", T.IntegerType()),
    T.StructField("p_route_ft", T.ArrayType(T.DoubleType())), T.StructField("p_lat", T.ArrayType(T.DoubleType())),
    T.StructField("p_lon", T.ArrayType(T.DoubleType())), T.StructField("p_piece", T.ArrayType(T.IntegerType())),
    T.StructField("p_seg", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()),
])


def flat(lists, of: pa.DataType = pa.float64()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, size) of a column of lists; null lists are empty."""
    lists = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(of))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False), offsets[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)


def by_line(chain: tuple, span: np.ndarray) -> dict[tuple[bytes, float], list[int]]:
    """Rows of one chainage and one span; those without length are left out."""
    values, first, size = chain
    found: dict[tuple[bytes, float], list[int]] = {}
    for i, (a, n, s) in enumerate(zip(first.tolist(), size.tolist(), span.tolist(), strict=True)):
        if n >= 2 and values[a + n - 1] > 0:
            found.setdefault((values[a:a + n].tobytes(), s), []).append(i)
    return found


def fractions_of(sheets: tuple, on_route: tuple) -> list[np.ndarray]:
    """`sheet_fractions` of every row, worked out once for equal sheets."""
    known, out = {}, []
    (v, a, n), (w, b, m) = sheets, on_route
    for i, k, j, q in zip(a.tolist(), n.tolist(), b.tolist(), m.tolist(), strict=True):
        key = (v[i:i + k].tobytes(), w[j:j + q].tobytes())
        if key not in known:
            known[key] = sheet_fractions(v[i:i + k], w[j:j + q])
        out.append(known[key])
    return out


@arrow_udf(ANCHOR)
def best_window(chain: pa.Array, lat: pa.Array, lon: pa.Array, rel: pa.Array, span: pa.Array, sheets: pa.Array, route_sheets: pa.Array) -> pa.Array:
    """Best window of every row; rows of one route and span are scored together."""
    chains, (la, la0, _), (lo, lo0, _), (x, x0, xn) = flat(chain), flat(lat), flat(lon), flat(rel)
    spans = np.asarray(span, dtype=float)
    fractions = fractions_of(flat(sheets, pa.int32()), flat(route_sheets, pa.int32()))
    n, lines = len(spans), {}
    numbers = {c: np.zeros(n) for c in ("start_ft", "end_ft", "window_score", "bias")}
    whole = {c: np.zeros(n, np.int32) for c in ("n_windows", "n_pieces")}
    kinds: list[str | None] = [None] * n
    order, seg_, ratio_, piece_, at_ = [], [], [], [], []
    for (key, s), members in by_line(chains, spans).items():
        line = line_of(np.frombuffer(key), lines)
        start, end, kind = windows_of(line, s)
        m = np.array(members)
        i, j, score, bias = leading_windows(line, s, x, x0[m], xn[m], np.stack([bias_of(line, s, fractions[k]) for k in members]))
        by = np.lexsort((start[j], np.abs(np.abs(end[j] - start[j]) - s), -bias, -score, i))
        by = by[np.unique(i[by], return_index=True)[1]]
        best = j[by]
        numbers["start_ft"][m], numbers["end_ft"][m], numbers["window_score"][m], numbers["bias"][m] = half_up(start[best], 2), half_up(end[best], 2), score[by], bias[by]
        whole["n_windows"][m], whole["n_pieces"][m] = len(start), line.n_pieces
        for k, w in zip(members, kind[best].tolist(), strict=True):
            kinds[k] = "full_route_window" if w < 0 else TYPES[w]
        size = xn[m]
        at = np.repeat(start[best], size) + x[np.arange(size.sum()) + np.repeat(x0[m] - (np.cumsum(size) - size), size)]
        seg, ratio, piece = line.locate(at)
        for held, new in ((order, m), (seg_, seg), (ratio_, ratio), (piece_, piece), (at_, at)):
            held.append(new)
    rows = np.concatenate(order) if order else np.empty(0, int)
    # back to the order of the rows
    counts = np.zeros(n, np.int64)
    counts[rows] = xn[rows]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    to = np.arange(offsets[-1]) + np.repeat(offsets[rows] - (np.cumsum(xn[rows]) - xn[rows]), xn[rows])
    row = np.repeat(np.arange(n), counts)

    def placed(parts: list[np.ndarray], dtype) -> np.ndarray:
        out = np.empty(offsets[-1], dtype)
        if parts:
            out[to] = np.concatenate(parts)
        return out

    seg, ratio = placed(seg_, np.int32), placed(ratio_, float)

    def between(v: np.ndarray, first: np.ndarray) -> np.ndarray:
        a = v.take(first[row] + seg)
        return half_up(a + (v.take(first[row] + seg + 1) - a) * ratio, 8)

    def lists(values: np.ndarray, of: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, of))

    made = {**{c: pa.array(v) for c, v in numbers.items()}, **{c: pa.array(v) for c, v in whole.items()}, "window_type": pa.array(kinds, pa.string()),
            "p_route_ft": lists(half_up(placed(at_, float), 2), pa.float64()), "p_lat": lists(between(la, la0), pa.float64()),
            "p_lon": lists(between(lo, lo0), pa.float64()), "p_piece": lists(placed(piece_, np.int32), pa.int32()), "p_seg": lists(seg, pa.int32())}
    return pa.StructArray.from_arrays([made[c] for c in ANCHOR.names], ANCHOR.names)


def route_sheets(index: DataFrame) -> DataFrame:
    """Ordered sheets that show each route."""
    return index.groupBy("project_id", "route_id").agg(F.sort_array(F.collect_set("sheet")).alias("route_sheets"))


def hypothesis_inputs(ranked: DataFrame, groups: DataFrame, catalog: DataFrame, index: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """Top routes of each group with the geometry, stations and sheets needed to anchor them.

    Arrays are made below the joins: what reaches the vectorised call are plain columns.
    """
    top = ranked.where(F.col("rank") <= cfg.keep_anchored)
    lines = catalog.select("project_id", "route_id", "coords", "chain", "total_ft",
                           F.transform("coords", lambda p: p["lat"]).alias("lats"), F.transform("coords", lambda p: p["lon"]).alias("lons"))
    rel = F.transform("station_rows", lambda r: F.greatest(r["station_ft"] - F.col("min_station_ft"), F.lit(0.0)))
    feet = F.transform("station_rows", lambda r: F.struct(r["station_ft"].alias("station_ft")))
    station = groups.select(*GROUP, "tokens_key", "min_station_ft", "max_station_ft", "row_count", feet.alias("station_rows"), rel.alias("rel"))
    usable = (F.size("allowed_routes") == 0) | F.array_contains("allowed_routes", F.col("route_id"))
    return (
        top.join(station, GROUP).join(lines, ["project_id", "route_id"]).join(route_sheets(index), ["project_id", "route_id"], "left")
        .withColumn("route_sheets", F.when(usable, F.col("route_sheets")))
    )


#: How a hypothesis was placed: by its best window, or not at all.
SLIDING, NO_GEOMETRY = "true_sliding_window_segment_scorer", "invalid_route_geometry"


def anchor(inputs: DataFrame, cfg: Matching = Matching()) -> DataFrame:
    """Best window per (group, route), combined score and anchored rank.

    A route without length has no window: its hypothesis stays, at 0 ft, with the route's own
    score and without an anchor strategy, which the checks that follow take for a bad anchor.
    """
    usable = F.coalesce((F.col("total_ft") > 0) & (F.size("chain") >= 2), F.lit(False))
    best = best_window("chain", "lats", "lons", "rel", "span_ft", "sheets", "route_sheets")
    every = inputs.withColumns({"w": best, "anchor_method": F.when(usable, SLIDING).otherwise(NO_GEOMETRY), "anchor_strategy": F.when(usable, SLIDING).otherwise("")})
    every = every.select("*", "w.*").drop("w", "lats", "lons")
    every = every.withColumn("combined", F.round(F.round(F.least(F.lit(1.0), F.col("score") + F.col("window_score") * cfg.window_weight), 9), 6))
    order = [F.desc("combined"), F.desc("score"), F.asc("route_name"), F.asc("route_id")]
    return every.withColumn("anchor_rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order)))


def mapped_ft(station_ft: Column, min_ft: Column, span_ft: Column, total_ft: Column, start_ft: Column) -> Column:
    """Route distance of a station: from the window start when the group has a span, else absolute; clamped."""
    relative = (total_ft > 0) & (span_ft > 0)
    at = F.when(relative, start_ft + F.greatest(station_ft - min_ft, F.lit(0.0))).otherwise(station_ft + start_ft)
    return F.greatest(F.least(at, total_ft), F.lit(0.0))


def absolute_anchors(groups: DataFrame) -> DataFrame:
    """Groups put back at their own stations (offset 0): relative range when they have a span."""
    relative = F.col("span_ft") > 0
    return groups.select(
        *GROUP, F.lit(0.0).alias("anchor_offset_ft"),
        F.when(relative, 0.0).otherwise(F.col("min_station_ft")).alias("anchored_start_ft"),
        F.when(relative, F.col("span_ft")).otherwise(F.col("max_station_ft")).alias("anchored_end_ft"),
        F.lit("true_station_position_no_fabrication").alias("anchor_strategy"))
