"""Design routes: vertices to chainage, segments, densified catalog, linear referencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import Densify
from trenchline.functions import geo
from trenchline.functions import text as tx

KEY = ["project_id", "route_id"]
BIN_FT = 100.0


def clean_vertices(vertices: DataFrame) -> DataFrame:
    """Finite vertices without consecutive repeats."""
    good = ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    w = Window.partitionBy(*KEY).orderBy("idx")
    same = (F.abs(F.col("lat") - F.lag("lat").over(w)) <= geo.SAME_DEG) & (F.abs(F.col("lon") - F.lag("lon").over(w)) <= geo.SAME_DEG)
    return vertices.where(good).withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")


def with_chainage(vertices: DataFrame) -> DataFrame:
    """Adds feet of each vertex from the start of its route."""
    w = Window.partitionBy(*KEY).orderBy("idx")
    step = geo.haversine_ft(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return vertices.withColumn("step_ft", F.coalesce(step, F.lit(0.0))).withColumn("chain_ft", F.sum("step_ft").over(w))


def route_segments(chained: DataFrame, chunk_ft: float = 60.0) -> DataFrame:
    """One row per segment with its ends, feet range and virtual piece numbering."""
    w = Window.partitionBy(*KEY).orderBy("idx")
    base = (
        chained.select(
            *KEY, (F.row_number().over(w) - 2).alias("seg_idx"),
            F.lag("lat").over(w).alias("a_lat"), F.lag("lon").over(w).alias("a_lon"),
            F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
            F.lag("chain_ft").over(w).alias("start_ft"), F.col("chain_ft").alias("end_ft"))
        .where(F.col("seg_idx") >= 0)
        .withColumn("n_chunks", geo.chunks(F.col("end_ft") - F.col("start_ft"), chunk_ft))
    )
    ws = Window.partitionBy(*KEY).orderBy("seg_idx")
    return base.withColumn("chunk_base", (F.sum("n_chunks").over(ws) - F.col("n_chunks")).cast("int"))


def densify(chained: DataFrame, step_ft: float = Densify().step_ft) -> DataFrame:
    """Vertices every step_ft along each route plus both ends; bends in between are not kept.

    Each segment emits the multiples of the step that fall inside it, so no join is
    needed and the work is spread by segment.
    """
    step = max(15.0, step_ft)
    total = F.max("end_ft").over(Window.partitionBy(*KEY))
    segs = route_segments(chained).withColumn("total_ft", total)
    inner_count = (F.ceil((F.col("total_ft") - 1e-6) / step) - 1).cast("int")
    first = F.floor(F.col("start_ft") / step).cast("int") + 1
    last = F.least(F.floor(F.col("end_ft") / step).cast("int"), inner_count)
    ks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    ratio = (F.col("k") * step - F.col("start_ft")) / F.greatest(F.col("end_ft") - F.col("start_ft"), F.lit(1e-9))
    inner = segs.withColumn("k", F.explode(ks)).select(
        *KEY, F.col("k").alias("idx"),
        (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * ratio).alias("lat"),
        (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * ratio).alias("lon"))
    starts = segs.where("seg_idx = 0").select(*KEY, F.lit(0).alias("idx"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"))
    ends = segs.where("end_ft = total_ft").select(
        *KEY, (inner_count + 1).alias("idx"), F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon"))
    return inner.unionByName(starts).unionByName(ends)


def as_polylines(chained: DataFrame) -> DataFrame:
    """One row per route: coords and chain arrays, exact length and point count."""
    packed = chained.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon", "chain_ft"))).alias("v"))
    return packed.select(
        *KEY, F.transform("v", lambda p: geo.point(p["lat"], p["lon"])).alias("coords"),
        F.transform("v", lambda p: p["chain_ft"]).alias("chain"),
        F.element_at("v", -1)["chain_ft"].alias("total_ft"), F.size("v").alias("point_count"))


def build_catalog(vertices: DataFrame, meta: DataFrame) -> DataFrame:
    """Route catalog: densified geometry with chainage, length, role and catalog rank."""
    dense = with_chainage(densify(with_chainage(clean_vertices(vertices))))
    rank = Window.partitionBy("project_id").orderBy(F.desc("length_ft"), "route_name", "route_id")
    return (
        as_polylines(dense).where("point_count >= 2").join(meta, KEY)
        .withColumns({"length_ft": F.round("total_ft", 2),
                      "route_role": tx.route_role(F.col("source_folder"), F.col("route_name"))})
        .withColumn("catalog_rank", F.row_number().over(rank))
    )


def default_routes(catalog: DataFrame) -> DataFrame:
    """The longest route of each project."""
    best = F.min_by(F.struct("route_id", "route_name", "length_ft"), F.col("catalog_rank"))
    return catalog.groupBy("project_id").agg(best.alias("r")).select("project_id", "r.*")


def active_routes(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """The active route of each project: the chosen one (ids compared without outer blanks), else the longest.

    `chosen` has project_id and route_id.  A route without geometry gets that of the first
    catalog entry that has one.
    """
    asked = chosen.select("project_id", F.trim("route_id").alias("asked"))
    facts = F.struct("route_id", "route_name", "length_ft", "coords")
    drawn = F.size("coords") >= 2
    picked = catalog.join(asked, "project_id", "left").groupBy("project_id").agg(
        F.min_by(facts, F.when(F.trim("route_id") == F.col("asked"), F.col("catalog_rank"))).alias("own"),
        F.min_by(facts, "catalog_rank").alias("longest"), F.min_by(F.when(drawn, F.col("coords")), F.when(drawn, F.col("doc_pos"))).alias("first_coords"))
    r = F.coalesce("own", "longest")
    return picked.select("project_id", r["route_id"].alias("route_id"), r["route_name"].alias("route_name"), r["length_ft"].alias("length_ft"),
                         F.when(F.size(r["coords"]) >= 2, r["coords"]).otherwise(F.col("first_coords")).alias("coords"))


def simple_routes(vertices: DataFrame, min_points: int = 3, min_station: int = 50) -> DataFrame:
    """Simple list: whole-foot end station; short or two-point lines left out."""
    metres = Window.partitionBy(*KEY).orderBy("idx")
    step = geo.haversine_m(F.lag("lat").over(metres), F.lag("lon").over(metres), F.col("lat"), F.col("lon"))
    return (
        vertices.withColumn("m", step).groupBy(*KEY)
        .agg(F.count("*").alias("n_points"), F.floor(F.sum("m") / 0.3048 + 1e-9).cast("int").alias("end_station"))
        .withColumn("start_station", F.lit(0))
        .where((F.col("n_points") >= min_points) & (F.col("end_station") > min_station))
    )


def locate(points: DataFrame, segments: DataFrame, feet: str = "at_ft") -> DataFrame:
    """Point on a route at a distance (clamped to the route), with segment and virtual piece.

    A range join turned into an equi-join on 100-ft bins of the route, so one long or
    busy route spreads over its bins.
    """
    totals = segments.groupBy(*KEY).agg(F.max("end_ft").alias("total_ft"))
    at = points.join(totals, KEY).withColumn("_d", F.greatest(F.least(F.col(feet), F.col("total_ft")), F.lit(0.0)))
    at = at.withColumn("_bin", F.floor(F.col("_d") / BIN_FT).cast("int"))
    binned = segments.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("start_ft") / BIN_FT).cast("int"), F.floor(F.col("end_ft") / BIN_FT).cast("int"))))
    hit = ((F.col("_d") > F.col("start_ft")) | ((F.col("_d") == 0) & (F.col("seg_idx") == 0))) & (F.col("_d") <= F.col("end_ft"))
    ratio = (F.col("_d") - F.col("start_ft")) / F.greatest(F.col("end_ft") - F.col("start_ft"), F.lit(1e-9))
    piece = F.least(F.col("n_chunks") - 1, F.floor(F.col("ratio") * F.col("n_chunks")).cast("int"))
    return (
        at.join(binned, [*KEY, "_bin"]).where(hit).withColumn("ratio", ratio)
        .withColumns({
            "lat": F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("ratio"),
            "lon": F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("ratio"),
            "virtual_idx": F.col("chunk_base") + piece,
        })
        .select(*points.columns, "seg_idx", "ratio", "virtual_idx", "lat", "lon")
    )


def _cells(lat: Column, lon: Column, lat_deg: float, lon_deg: float) -> Column:
    return F.struct(F.floor(lat / lat_deg).alias("y"), F.floor(lon / lon_deg).alias("x"))


def nearest_on_route(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest place on the named route of each point: min over its segments.

    Planar feet scaled at the middle of each segment; partial min per segment partition.
    """
    east = geo.lon_scale((F.col("a_lat") + F.col("b_lat")) / 2)
    bx, by = (F.col("b_lon") - F.col("a_lon")) * east, (F.col("b_lat") - F.col("a_lat")) * geo.FEET_PER_DEG
    px, py = (F.col("p_lon") - F.col("a_lon")) * east, (F.col("p_lat") - F.col("a_lat")) * geo.FEET_PER_DEG
    t = geo.along(px, py, bx, by, 0.0)
    w = Window.partitionBy(*KEY).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    planar = F.sqrt(bx * bx + by * by)
    segs = segments.withColumn("planar_ft", planar).withColumn("planar_before", F.coalesce(F.sum("planar_ft").over(w), F.lit(0.0)))
    scored = points.join(segs, KEY).withColumn("t", t).withColumns({
        "distance_ft": F.sqrt(F.pow(px - bx * F.col("t"), 2) + F.pow(py - by * F.col("t"), 2)),
        "snap_lat": F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("t"),
        "snap_lon": F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("t"),
        "offset_ft": F.col("planar_before") + F.col("planar_ft") * F.col("t")})
    best = F.min_by(F.struct("snap_lat", "snap_lon", "distance_ft", "offset_ft", "seg_idx", "t"),
                    F.struct(F.round("distance_ft", 6), F.col("seg_idx")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def bounds(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.groupBy(*keys).agg(
        F.struct(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                 F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon")).alias("box"),
        F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))


def bends(chained: DataFrame, min_deg: float = 12.0) -> DataFrame:
    """Places where a route's heading changes by at least min_deg."""
    w = Window.partitionBy(*KEY).orderBy("idx")
    lat0 = F.first("lat").over(w)
    heading = geo.heading_rad(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), lat0)
    turned = F.abs(F.degrees(F.lead("heading").over(w) - F.col("heading")))
    folded = F.least(F.pmod(turned, F.lit(360.0)), 360.0 - F.pmod(turned, F.lit(360.0)))
    return (chained.withColumn("heading", heading).withColumn("bend_deg", folded)
            .where(F.col("bend_deg") >= min_deg).select(*KEY, "idx", F.col("chain_ft").alias("at_ft"), "bend_deg"))


def turn_penalty(chained: DataFrame, min_deg: float = 25.0) -> DataFrame:
    """Vertices whose interior angle is at least min_deg, per 500 ft of route."""
    w = Window.partitionBy(*KEY).orderBy("idx")
    angle = geo.turn_deg(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    inner = F.lag("idx").over(w).isNotNull() & F.lead("idx").over(w).isNotNull()
    return (chained.withColumn("angle", F.when(inner, angle)).groupBy(*KEY)
            .agg(F.count_if(F.col("angle") >= min_deg).alias("turns"), F.max("chain_ft").alias("length_ft"))
            .withColumn("penalty", F.when(F.col("length_ft") <= 0, F.col("turns").cast("double")).otherwise(
                F.round(F.col("turns") / F.greatest(F.col("length_ft") / 500.0, F.lit(1.0)), 2))))


def terminal_bearings(polylines: DataFrame) -> DataFrame:
    """Bearing leaving the start and bearing arriving at the end."""
    a, b, y, z = F.get("coords", F.lit(0)), F.get("coords", F.lit(1)), F.element_at("coords", -2), F.element_at("coords", -1)
    return polylines.select(
        *KEY, geo.bearing_deg(a["lat"], a["lon"], b["lat"], b["lon"]).alias("start_bearing"),
        geo.bearing_deg(y["lat"], y["lon"], z["lat"], z["lon"]).alias("end_bearing"))


def resample(vertices: DataFrame, spacing_ft: float = 25.0) -> DataFrame:
    """Evenly spaced points in local metres with unit tangent and left normal.

    Every segment emits the multiples of the spacing it owns; a point on a joint
    belongs to the segment that ends there.
    """
    spacing = spacing_ft * 0.3048
    w = Window.partitionBy(*KEY).orderBy("idx")
    per_lat, east = 111320.0, geo.lon_scale(F.col("lat0"), 111320.0)
    local = vertices.withColumns({"lat0": F.first("lat").over(w), "lon0": F.first("lon").over(w)}).withColumns({
        "x": (F.col("lon") - F.col("lon0")) * east, "y": (F.col("lat") - F.col("lat0")) * per_lat})
    legs = local.withColumns({"ax": F.lag("x").over(w), "ay": F.lag("y").over(w)}).where("ax IS NOT NULL")
    legs = legs.withColumn("len", F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2))).where("len > 0")
    legs = legs.withColumn("end_m", F.sum("len").over(w)).withColumn("start_m", F.col("end_m") - F.col("len"))
    legs = legs.withColumn("is_last", F.lead("idx").over(w).isNull())
    first = F.when(F.col("start_m") < 1e-9, 0).otherwise(F.floor((F.col("start_m") + 1e-9) / spacing).cast("int") + 1)
    last = F.floor((F.col("end_m") + F.when(F.col("is_last"), 0.001).otherwise(1e-9)) / spacing).cast("int")
    ks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tx_, ty_ = (F.col("x") - F.col("ax")) / F.col("len"), (F.col("y") - F.col("ay")) / F.col("len")
    t = F.least(F.greatest((F.col("k") * spacing - F.col("start_m")) / F.col("len"), F.lit(0.0)), F.lit(1.0))
    return (
        legs.withColumn("k", F.explode(ks)).withColumns({"t": t, "tangent_x": tx_, "tangent_y": ty_})
        .withColumns({"plan_x": F.col("ax") + (F.col("x") - F.col("ax")) * F.col("t"),
                      "plan_y": F.col("ay") + (F.col("y") - F.col("ay")) * F.col("t")})
        .select(*KEY, "k", (F.col("k") * spacing_ft).alias("station_ft"), "plan_x", "plan_y",
                (F.col("lat0") + F.col("plan_y") / per_lat).alias("lat"),
                (F.col("lon0") + F.col("plan_x") / geo.lon_scale(F.col("lat0"), 111320.0)).alias("lon"),
                "tangent_x", "tangent_y", (-F.col("tangent_y")).alias("normal_x"), F.col("tangent_x").alias("normal_y")))
