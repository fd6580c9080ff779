"""Distances, projections and polyline arithmetic as Column expressions.

Points are struct(lat, lon); a polyline is array<struct(lat, lon)> with an equally
long `chain` array of feet from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trenchline.config import EARTH_RADIUS_M, FEET_PER_DEG, FEET_PER_M
from trenchline.functions.stations import let

SAME_DEG = 1e-9


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


def haversine_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) * FEET_PER_M


def flat_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular feet at 69 miles per degree."""
    north = (lat1 - lat2) * 69.0
    east = F.cos(F.radians((lat1 + lat2) / 2)) * (lon1 - lon2) * 69.0
    return F.sqrt(north * north + east * east) * 5280.0


def lon_scale(lat: Column, per_deg: float = FEET_PER_DEG, floor: float = 0.0) -> Column:
    """Units per degree of longitude at a latitude."""
    return F.greatest(F.cos(F.radians(lat)), F.lit(floor)) * per_deg


def along(px: Column, py: Column, bx: Column, by: Column, eps: float) -> Column:
    """Clamped share of the way along (0,0)-(bx,by) nearest to (px,py)."""
    sq = bx * bx + by * by
    return F.when(sq > eps, F.least(F.greatest((px * bx + py * by) / sq, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def point_segment_ft(plat: Column, plon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Planar distance of a point to a segment, scaled at the mean of the three latitudes."""
    east = lon_scale((plat + alat + blat) / 3, floor=0.2)
    px, py = (plon - alon) * east, (plat - alat) * FEET_PER_DEG
    bx, by = (blon - alon) * east, (blat - alat) * FEET_PER_DEG
    t = along(px, py, bx, by, 1e-9)
    dx, dy = px - bx * t, py - by * t
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    lat1, lat2, dlon = F.radians(alat), F.radians(blat), F.radians(blon - alon)
    y = F.sin(dlon) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_gap_deg(a: Column, b: Column) -> Column:
    diff = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(diff, 360.0 - diff)


def heading_rad(alat: Column, alon: Column, blat: Column, blon: Column, lat0: Column) -> Column:
    """Planar heading of a segment, scaled at the route's first latitude."""
    return F.atan2((blat - alat) * FEET_PER_DEG, (blon - alon) * lon_scale(lat0))


def turn_deg(alat: Column, alon: Column, blat: Column, blon: Column, clat: Column, clon: Column) -> Column:
    """Interior angle at b, in degrees of the raw coordinate plane."""
    ux, uy, vx, vy = alat - blat, alon - blon, clat - blat, clon - blon
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cosine = (ux * vx + uy * vy) / (nu * nv)
    return F.when((nu <= 1e-12) | (nv <= 1e-12), 0.0).otherwise(
        F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))


def chunks(length_ft: Column, chunk_ft: float = 60.0) -> Column:
    """Equal pieces of at most about chunk_ft; slack keeps float noise from adding one."""
    return F.greatest(F.lit(1), F.ceil(length_ft / chunk_ft - 1e-6).cast("int"))


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def same_place(a: Column, b: Column) -> Column:
    return (F.abs(a["lat"] - b["lat"]) <= SAME_DEG) & (F.abs(a["lon"] - b["lon"]) <= SAME_DEG)


def without_repeats(coords: Column) -> Column:
    """Polyline without consecutive equal points."""
    return F.filter(coords, lambda p, i: (i == 0) | ~same_place(p, F.get(coords, F.greatest(i - 1, F.lit(0)))))


def finite(coords: Column) -> Column:
    """Polyline without null, NaN or infinite points."""
    def good(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.filter(coords, lambda p: p.isNotNull() & good(p["lat"]) & good(p["lon"]))


def length_ft(coords: Column) -> Column:
    """Polyline length, for short arrays; long routes use the vertex table."""
    steps = F.transform(coords, lambda p, i: let(
        F.get(coords, F.greatest(i - 1, F.lit(0))), lambda q: haversine_ft(q["lat"], q["lon"], p["lat"], p["lon"])))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def point_at(coords: Column, chain: Column, feet: Column) -> Column:
    """Point at a distance along the polyline, clamped to its ends."""
    def within(target: Column) -> Column:
        last = F.size(chain) - 1
        seg = F.least(F.greatest(F.size(F.filter(chain, lambda c: c < target)), F.lit(1)), last)
        return let(F.struct(F.get(coords, seg - 1).alias("a"), F.get(coords, seg).alias("b"),
                            F.get(chain, seg - 1).alias("s"), F.get(chain, seg).alias("e"), target.alias("t")),
                   lambda q: let(
                       F.least(F.greatest((q["t"] - q["s"]) / F.greatest(q["e"] - q["s"], F.lit(1e-9)), F.lit(0.0)), F.lit(1.0)),
                       lambda r: point(q["a"]["lat"] + (q["b"]["lat"] - q["a"]["lat"]) * r,
                                       q["a"]["lon"] + (q["b"]["lon"] - q["a"]["lon"]) * r)))
    clamped = F.greatest(F.least(feet, F.element_at(chain, -1)), F.lit(0.0))
    return let(clamped, within)


def clip(coords: Column, chain: Column, start_ft: Column, end_ft: Column) -> Column:
    """Stretch between two distances: exact ends, the vertices strictly between; empty when reversed."""
    total = F.element_at(chain, -1)
    s = F.greatest(F.least(start_ft, total), F.lit(0.0))
    e = F.greatest(F.least(end_ft, total), F.lit(0.0))
    inside = F.filter(coords, lambda p, i: (F.get(chain, i) > s) & (F.get(chain, i) < e))
    whole = F.concat(F.array(point_at(coords, chain, s)), inside, F.array(point_at(coords, chain, e)))
    empty = F.slice(coords, 1, 0)
    return F.when(e > s, let(whole, without_repeats)).otherwise(empty)


def slice_whole(coords: Column, chain: Column, start_ft: Column, end_ft: Column) -> Column:
    """Vertices of every whole segment that touches the range."""
    def touched(i: Column) -> Column:
        before = (i > 0) & (F.get(chain, i) >= start_ft) & (F.get(chain, F.greatest(i - 1, F.lit(0))) <= end_ft)
        after = (F.get(chain, i + 1) >= start_ft) & (F.get(chain, i) <= end_ft)
        return before | F.coalesce(after, F.lit(False))
    return F.filter(coords, lambda p, i: touched(i))


def offset_line(coords: Column, offset_deg: float) -> Column:
    """Polyline moved sideways by a fixed offset in degrees."""
    def moved(p: Column, i: Column) -> Column:
        other = F.coalesce(F.get(coords, i + 1), F.get(coords, F.greatest(i - 1, F.lit(0))))
        return let(other, lambda q: let(
            F.struct((q["lon"] - p["lon"]).alias("dx"), (q["lat"] - p["lat"]).alias("dy")),
            lambda d: let(F.sqrt(d["dx"] * d["dx"] + d["dy"] * d["dy"]), lambda n: F.when(n == 0, point(p["lat"], p["lon"])).otherwise(
                point(p["lat"] + d["dx"] / n * offset_deg, p["lon"] - d["dy"] / n * offset_deg)))))
    return F.transform(coords, moved)


def joined(parts: Column) -> Column:
    """Polylines joined end to end, repeated joints dropped."""
    return let(F.flatten(parts), lambda c: F.filter(
        c, lambda p, i: (i == 0) | (p != F.get(c, F.greatest(i - 1, F.lit(0))))))


def merged(parts: Column) -> Column:
    """All points of several polylines in order, each place (8 decimals) once."""
    return let(F.flatten(parts), lambda c: let(
        F.transform(c, lambda p: point(F.round(p["lat"], 8), F.round(p["lon"], 8))),
        lambda keys: F.filter(c, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def ring(coords: Column) -> Column:
    """Polygon ring whose last point repeats its first."""
    return F.when(F.get(coords, F.lit(0)) == F.element_at(coords, -1), coords).otherwise(
        F.concat(coords, F.slice(coords, 1, 1)))


def coord_text(coords: Column) -> Column:
    """`lon,lat,0` tuples for map files."""
    return F.array_join(F.transform(coords, lambda p: F.concat(
        p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))), " ")


def inside_box(lat: Column, lon: Column, box: Column) -> Column:
    return (lat >= box["min_lat"]) & (lat <= box["max_lat"]) & (lon >= box["min_lon"]) & (lon <= box["max_lon"])


def boxes_touch(outer: Column, inner: Column, lat_pad: Column, lon_pad: Column) -> Column:
    """Buffered overlap of two boxes; true when either is missing."""
    hit = ((inner["max_lat"] >= outer["min_lat"] - lat_pad) & (inner["min_lat"] <= outer["max_lat"] + lat_pad)
           & (inner["max_lon"] >= outer["min_lon"] - lon_pad) & (inner["min_lon"] <= outer["max_lon"] + lon_pad))
    return outer.isNull() | inner.isNull() | hit
