"""Phone walks: accepted fixes, snapped trails, notes taken on the way, steady display lines.

Batch twins of the streaming job; both apply the same rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import EARTH_RADIUS_M, Walk
from trenchline.functions import geo
from trenchline.functions.stations import let
from trenchline.operators.ordered import ordered_pass
from trenchline.operators.sequences import split_blocks, with_last_mark, with_neighbours

DAY_S = 86400.0
WALK = ["session_id", "walk_s"]


def seconds(ts: Column) -> Column:
    """Seconds of a timestamp, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


def good_fix(accuracy_m: Column, delay_s: Column, cfg: Walk = Walk()) -> Column:
    """Sharp enough and fresh enough, by itself."""
    return F.coalesce(~F.isnan(accuracy_m) & (accuracy_m > 0) & (accuracy_m <= cfg.max_accuracy_m) & (F.abs(delay_s) <= cfg.max_age_s), F.lit(False))


def split_walks(fixes: DataFrame, gap_s: float = 1800.0) -> DataFrame:
    """Adds walk_s, the start of the walk a fix belongs to: a session falls apart at long gaps.

    Days are the blocks, so one endless session spreads over its days.
    """
    order = ["t_s", "event_id"]
    blocked = split_blocks(fixes, ["session_id"], F.floor(F.col("t_s") / DAY_S))
    near = with_neighbours(blocked, ["session_id"], order, ["t_s"])
    marked = near.withColumn("_mark", F.when(F.col("prev").isNull() | (F.col("t_s") - F.col("prev.t_s") > gap_s), F.col("t_s")))
    return with_last_mark(marked, ["session_id"], order, "_mark", "walk_s").drop("prev", "next", "_mark", "_block")


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half_lat, half_lon = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon * half_lon
    return math.atan2(math.sqrt(a), math.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


class LastKept:
    """Keeps a fix that is far and late enough from the last one kept; rows are (t_s, event_id, lat, lon, accuracy_m)."""

    def __init__(self, cfg: Walk):
        self.cfg, self.last, self.pos = cfg, None, -1

    def push(self, row: tuple) -> Iterator[tuple]:
        t, _, lat, lon, _ = row
        if self.last is None or (t - self.last[0] >= self.cfg.min_interval_s and _metres(self.last[1], self.last[2], lat, lon) >= self.cfg.min_move_m):
            self.last, self.pos = (t, lat, lon), self.pos + 1
            yield (self.pos, *row)

    def end(self) -> Iterator[tuple]:
        return iter(())


def accept_fixes(walked: DataFrame, cfg: Walk = Walk()) -> DataFrame:
    """Fixes kept on each walk: good ones at least 1.5 m and 2 s from the last one kept.

    The rule needs the last kept fix, so walks are ordered passes, many in one task.
    """
    good = walked.where(good_fix(F.col("accuracy_m"), F.col("delay_s"), cfg)).select(
        *WALK, F.col("t_s").cast("double").alias("t_s"), "event_id", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "accuracy_m")))
    kind = dict(good.dtypes)
    schema = ", ".join(f"{c} {kind.get(c, 'int')}" for c in (*WALK, "pos", "t_s", "event_id", "lat", "lon", "accuracy_m"))
    return ordered_pass(good, WALK, ["t_s", "event_id"], lambda: LastKept(cfg), schema)


def snap_to_line(coords: Column, chain: Column, lat: Column, lon: Column) -> Column:
    """Struct(distance_ft, lat, lon, route_ft): nearest place on a polyline held in the row.

    No shuffle and no state, so it serves streams as well as tables.
    """
    east = F.cos(F.radians(F.get(coords, F.lit(0))["lat"]))

    def leg(i: Column) -> Column:
        a, b = F.get(coords, i - 1), F.get(coords, i)
        px, py, bx, by = (lon - a["lon"]) * east, lat - a["lat"], (b["lon"] - a["lon"]) * east, b["lat"] - a["lat"]
        return let(F.struct(geo.along(px, py, bx, by, 1e-12).alias("t"), a.alias("a"), b.alias("b")), lambda q: let(
            F.struct((q["a"]["lat"] + (q["b"]["lat"] - q["a"]["lat"]) * q["t"]).alias("y"), (q["a"]["lon"] + (q["b"]["lon"] - q["a"]["lon"]) * q["t"]).alias("x"), q["t"].alias("t")),
            lambda s: F.struct(
                F.round(geo.haversine_ft(lat, lon, s["y"], s["x"]), 6).alias("d"), i.alias("i"), s["y"].alias("lat"), s["x"].alias("lon"),
                (F.get(chain, i - 1) + s["t"] * F.greatest(F.get(chain, i) - F.get(chain, i - 1), F.lit(1e-6))).alias("ft"))))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(coords) - 1), leg))
    return let(best, lambda b: F.struct(F.round(b["d"], 2).alias("distance_ft"), b["lat"].alias("lat"), b["lon"].alias("lon"), F.round(b["ft"], 2).alias("route_ft")))


def snapped_trail(accepted: DataFrame, sessions: DataFrame, polylines: DataFrame) -> DataFrame:
    """Accepted fixes on the route of their session; sessions need a route of two points."""
    lines = polylines.where(F.size("coords") >= 2).select("project_id", "route_id", "coords", "chain")
    return (accepted.join(sessions, "session_id").join(lines, ["project_id", "route_id"])
            .withColumn("s", snap_to_line(F.col("coords"), F.col("chain"), F.col("lat"), F.col("lon")))
            .withColumns({"snap_lat": F.col("s.lat"), "snap_lon": F.col("s.lon"), "route_ft": F.col("s.route_ft"), "distance_ft": F.col("s.distance_ft")}).drop("coords", "chain", "s"))


def located_entries(entries: DataFrame, accepted: DataFrame) -> DataFrame:
    """Notes with the last fix kept at or before them: an as-of join as one fill-forward.

    Entries without an earlier fix stay unlocated.
    """
    fix = accepted.select("session_id", "t_s", F.lit(0).alias("is_entry"), F.struct("event_id", "lat", "lon", F.col("t_s").alias("fix_s")).alias("fix"), F.lit(None).cast("bigint").alias("entry_id"),
                          F.lit(None).cast("string").alias("station_text"), F.lit(None).cast("string").alias("note"))
    note = entries.select("session_id", "t_s", F.lit(1).alias("is_entry"), F.lit(None).cast(fix.schema["fix"].dataType).alias("fix"), "entry_id", "station_text", "note")
    both = split_blocks(fix.unionByName(note), ["session_id"], F.floor(F.col("t_s") / DAY_S))
    filled = with_last_mark(both, ["session_id"], ["t_s", "is_entry", "entry_id"], "fix", "last_fix")
    return filled.where("is_entry = 1").select("session_id", "entry_id", "t_s", "station_text", "note", F.col("last_fix.event_id").alias("fix_id"),
                                               F.col("last_fix.lat").alias("lat"), F.col("last_fix.lon").alias("lon"))


def walk_sessions(walked: DataFrame) -> DataFrame:
    """Start, end and fix count of each walk."""
    return walked.groupBy(*WALK).agg(F.max("t_s").alias("ended_s"), F.count("*").alias("n_fixes"))


def _zigzag(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether b is a tiny detour between a and c; points are (lat, lon)."""
    east = math.radians(1) * EARTH_RADIUS_M * max(math.cos(math.radians(a[0])), 0.01)
    north = math.radians(1) * EARTH_RADIUS_M
    bx, by, cx, cy = (b[1] - a[1]) * east, (b[0] - a[0]) * north, (c[1] - a[1]) * east, (c[0] - a[0]) * north
    square = cx * cx + cy * cy
    off = math.hypot(bx, by) if math.sqrt(square) < 0.35 else abs(bx * cy - by * cx) / math.sqrt(square)
    t = 0.5 if square < 1e-6 else (bx * cx + by * cy) / square
    if off > 2.8 or not 0.04 <= t <= 0.96:
        return False
    ab, bc = _metres(*a, *b), _metres(*b, *c)
    return ab <= 14 and bc <= 14 and ab + bc <= _metres(*a, *c) + 1.8


class Steady:
    """Display line of a walk, a point at a time; rows are (pos, lat, lon).

    A point goes if it is a zigzag between the last kept point and the one after it; the first
    and the last stay.  A kept point is certain, and eased, once the next kept one is known.
    """

    def __init__(self) -> None:
        self.next = self.before = self.kept = None

    def push(self, row: tuple) -> Iterator[tuple]:
        if self.kept is None:
            self.kept = row
            return
        if self.next is not None and not _zigzag(self.kept[1:], self.next[1:], row[1:]):
            yield from self.keep(self.next)
        self.next = row

    def keep(self, row: tuple) -> Iterator[tuple]:
        pos, lat, lon = self.kept
        if self.before is not None:
            y, x = (self.before[i] * 0.22 + self.kept[i] * 0.56 + row[i] * 0.22 for i in (1, 2))
            if _metres(lat, lon, y, x) <= 2.2:
                lat, lon = y, x
        yield pos, lat, lon
        self.before, self.kept = self.kept, row

    def end(self) -> Iterator[tuple]:
        if self.next is not None:
            yield from self.keep(self.next)
        if self.kept is not None:
            yield self.kept


def steady_trail(trail: DataFrame) -> DataFrame:
    """Display line of an ended walk: tiny zigzags against the last kept point dropped, then
    each point eased toward its neighbours when that moves it at most 2.2 m.

    Expects pos, lat, lon per walk; walks are ordered passes, many in one task.
    """
    slim = trail.select(*WALK, F.col("pos").cast("int").alias("pos"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon")))
    return ordered_pass(slim, WALK, ["pos"], Steady, ", ".join(f"{c} {t}" for c, t in slim.dtypes))
