"""Field photos snapped to the design network, and the built paths between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import Billing, Snap
from trenchline.functions import geo
from trenchline.functions import text as tx
from trenchline.functions.stations import station_label
from trenchline.operators import routes
from trenchline.operators.sequences import split_blocks, with_neighbours, with_position
from trenchline.session import cut_lineage

KEY = ["project_id", "segment_id"]
BOUNDARY_TYPES = ("backbone", "lateral", "terminal_tail")
# Reasons a built stretch cycles through until someone reviews it.
REASONS = ("Utility conflict / obstacle avoidance", "Rock / bore depth adjustment", "Field deviation under review", "Alignment adjustment")


def network_segments(lines: DataFrame, cfg: Snap = Snap()) -> DataFrame:
    """Typed design segments; closed rings and long lines along the design's edge are boundaries.

    Expects coords, chain, total_ft, name, description, style.  The design box is one
    aggregate per project joined back.
    """
    spots = lines.select("project_id", F.explode("coords").alias("p"))
    box = spots.groupBy("project_id").agg(F.min("p.lat").alias("lo_lat"), F.max("p.lat").alias("hi_lat"), F.min("p.lon").alias("lo_lon"), F.max("p.lon").alias("hi_lon"))
    kind = tx.design_type(F.col("name"), F.col("description"), F.col("style"), F.col("total_ft"))
    first, last = F.get("coords", F.lit(0)), F.element_at("coords", -1)

    def edge(v: Column, lo: str, hi: str) -> Column:
        return (F.abs(v - F.col(lo)) < 0.0006) | (F.abs(v - F.col(hi)) < 0.0006)

    touches = F.aggregate("coords", F.lit(0), lambda n, p: n + edge(p["lat"], "lo_lat", "hi_lat").cast("int") + edge(p["lon"], "lo_lon", "hi_lon").cast("int"))
    closed = geo.haversine_ft(first["lat"], first["lon"], last["lat"], last["lon"]) < cfg.node_tolerance_ft
    rim = (F.col("total_ft") > 1200) & (touches / (F.size("coords") * 2) > 0.35) & F.col("kind.type").isin(*BOUNDARY_TYPES)
    return (lines.withColumn("kind", kind).join(box, "project_id").withColumn("is_boundary", closed | rim).select(
        *KEY, "name", "coords", "chain", F.round("total_ft", 2).alias("length_ft"), F.col("kind.type").alias("segment_type"),
        F.when(F.col("is_boundary"), "boundary").otherwise(F.col("kind.role")).alias("segment_role"),
        (F.col("kind.eligible") & ~F.col("is_boundary")).alias("eligible"), "is_boundary"))


def type_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("project_id", "segment_type").agg(F.count("*").alias("n"), F.round(F.sum("length_ft"), 2).alias("feet"))


def node_key(p: Column) -> Column:
    return F.concat(F.format_string("%.4f", F.round(p["lat"], 4)), F.lit("|"), F.format_string("%.4f", F.round(p["lon"], 4)))


def with_nodes(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("segment_role") == "network").withColumns({
        "start_node": node_key(F.get("coords", F.lit(0))), "end_node": node_key(F.element_at("coords", -1))})


def edges(noded: DataFrame) -> DataFrame:
    """Both directions of every eligible network segment."""
    e = noded.where("eligible").select("project_id", "segment_id", "length_ft", F.col("start_node").alias("src"), F.col("end_node").alias("dst"))
    return e.unionByName(e.select("project_id", "segment_id", "length_ft", F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_degrees(noded: DataFrame) -> DataFrame:
    return noded.select("project_id", F.explode(F.array("start_node", "end_node")).alias("node")).groupBy("project_id", "node").agg(F.count("*").alias("degree"))


def legs(segments: DataFrame) -> DataFrame:
    """Straight legs of eligible segments, with planar feet before each."""
    v = segments.where("eligible").select("project_id", F.col("segment_id").alias("route_id"), F.posexplode(F.arrays_zip("coords", "chain")).alias("idx", "p")).select(
        "project_id", "route_id", "idx", "p.coords.lat", "p.coords.lon", F.col("p.chain").alias("chain_ft"))
    s = routes.route_segments(v).withColumnRenamed("route_id", "segment_id")
    east = geo.lon_scale((F.col("a_lat") + F.col("b_lat")) / 2)
    bx, by = (F.col("b_lon") - F.col("a_lon")) * east, (F.col("b_lat") - F.col("a_lat")) * geo.FEET_PER_DEG
    w = Window.partitionBy(*KEY).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("planar_ft", F.sqrt(bx * bx + by * by))
    return s.withColumn("planar_before", F.coalesce(F.sum("planar_ft").over(w), F.lit(0.0))).where("planar_ft > 0")


def snap(points: DataFrame, segments: DataFrame, id_col: str, cfg: Snap = Snap()) -> DataFrame:
    """Nearest eligible segment within reach of each point (ids name one point of a project each).

    An equi-join on grid cells whose width in degrees follows the latitude of their row: legs
    cover all cells within reach of them, a point looks in one cell.  Exact distances decide.
    Each place is measured once however many points lie there.  Points and exploded legs are
    shuffled: their sizes are far above what the files they come from let expect.
    """
    y_deg = cfg.max_distance_ft / geo.FEET_PER_DEG * 1.01
    leg = legs(segments)

    def width(row: Column) -> Column:
        return F.lit(y_deg) / F.greatest(F.cos(F.radians(F.abs(row * y_deg))), F.lit(1e-3))

    def span(low: Column, high: Column, step) -> Column:
        return F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))

    reach = F.lit(y_deg) / F.greatest(F.cos(F.radians((F.col("a_lat") + F.col("b_lat")) / 2)), F.lit(1e-3))
    by_name = Window.partitionBy("project_id").orderBy("segment_id", "seg_idx")
    leg = leg.withColumn("leg_no", F.row_number().over(by_name).cast("long"))
    cells = leg.select("project_id", "leg_no", "a_lat", "a_lon", "b_lat", "b_lon").withColumn("cy", span(F.least("a_lat", "b_lat") - y_deg, F.greatest("a_lat", "b_lat") + y_deg, y_deg))
    cells = cells.withColumn("cx", span(F.least("a_lon", "b_lon") - reach, F.greatest("a_lon", "b_lon") + reach, width(F.col("cy"))))
    named = points.select("project_id", id_col, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct()
    at = named.select("project_id", "p_lat", "p_lon").distinct().withColumn("cy", F.floor(F.col("p_lat") / y_deg))
    at = at.withColumn("cx", F.floor(F.col("p_lon") / width(F.col("cy"))))

    def measured(pairs: DataFrame) -> DataFrame:
        east = geo.lon_scale((F.col("a_lat") + F.col("b_lat")) / 2)
        bx, by = (F.col("b_lon") - F.col("a_lon")) * east, (F.col("b_lat") - F.col("a_lat")) * geo.FEET_PER_DEG
        px, py = (F.col("p_lon") - F.col("a_lon")) * east, (F.col("p_lat") - F.col("a_lat")) * geo.FEET_PER_DEG
        on = pairs.withColumn("t", geo.along(px, py, bx, by, 0.0))
        return on.withColumn("distance_ft", F.sqrt(F.pow(px - bx * F.col("t"), 2) + F.pow(py - by * F.col("t"), 2)))

    # the nearest leg, ties by name, as one number (millionths of a foot, then the leg), which aggregates in place
    met = measured(at.join(cells.hint("merge"), ["project_id", "cy", "cx"])).where(F.col("distance_ft") <= cfg.max_distance_ft)
    rank = F.shiftleft(F.round(F.col("distance_ft") * 1e6).cast("long"), 32).bitwiseOR(F.col("leg_no"))
    best = met.groupBy("project_id", "p_lat", "p_lon").agg(F.min(rank).alias("rank"))
    best = best.withColumn("leg_no", F.col("rank").bitwiseAND((1 << 32) - 1)).drop("rank")
    found = named.join(measured(best.join(leg.hint("merge"), ["project_id", "leg_no"])).hint("merge"), ["project_id", "p_lat", "p_lon"])
    return found.select(
        "project_id", id_col, "segment_id", (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("t")).alias("snap_lat"),
        (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("t")).alias("snap_lon"), "distance_ft",
        (F.col("planar_before") + F.col("planar_ft") * F.col("t")).alias("offset_ft"),
        F.round(F.greatest(F.lit(0.0), 1 - F.col("distance_ft") / cfg.max_distance_ft), 3).alias("confidence"))


def with_route_offset(snapped: DataFrame, segments: DataFrame, id_col: str) -> DataFrame:
    """Adds each snapped point's feet along its project's main route (the longest eligible line).

    Points snapped to one place are measured once.
    """
    main = segments.where("eligible").groupBy("project_id").agg(F.min_by("segment_id", F.struct((-F.col("length_ft")).alias("l"), F.col("segment_id"))).alias("main"))
    v = segments.join(main, "project_id").where(F.col("segment_id") == F.col("main")).select("project_id", F.col("segment_id").alias("route_id"), F.posexplode(F.arrays_zip("coords", "chain")).alias("idx", "p"))
    line = routes.route_segments(v.select("project_id", "route_id", "idx", "p.coords.lat", "p.coords.lon", F.col("p.chain").alias("chain_ft")))
    spots = snapped.select("project_id", "snap_lat", "snap_lon").distinct()
    at = spots.join(main, "project_id").select("project_id", F.col("main").alias("route_id"), F.col("snap_lat").alias("p_lat"), F.col("snap_lon").alias("p_lon"))
    near = routes.nearest_on_route(at, line, ["project_id", "p_lat", "p_lon"]).select(
        "project_id", F.col("p_lat").alias("snap_lat"), F.col("p_lon").alias("snap_lon"), F.round("offset_ft", 2).alias("route_offset_ft"))
    return snapped.join(near.hint("merge"), ["project_id", "snap_lat", "snap_lon"]).select(*snapped.columns, "route_offset_ft")


def shortest_paths(links: DataFrame, sources: DataFrame, limit_ft: float = Snap().max_length_ft, max_rounds: int = 200) -> DataFrame:
    """Least feet and segments from each source node to every node within the limit.

    Rounds of joins relax only what improved in the round before; the table is checkpointed
    each round and the limit keeps each source's reach local.
    """
    start = sources.select("project_id", F.col("node").alias("src"), "node", F.lit(0.0).alias("feet"), F.array().cast("array<string>").alias("path"))
    known = cut_lineage(start.distinct())
    front = known
    step = links.select("project_id", F.col("src").alias("node"), F.col("dst").alias("next"), "length_ft", "segment_id")
    for _ in range(max_rounds):
        reach = (front.join(step, ["project_id", "node"]).select(
            "project_id", "src", F.col("next").alias("node"), (F.col("feet") + F.col("length_ft")).alias("feet"), F.array_append("path", F.col("segment_id")).alias("path"))
            .where(F.col("feet") <= limit_ft))
        better = reach.groupBy("project_id", "src", "node").agg(F.min(F.struct("feet", "path")).alias("b")).select("project_id", "src", "node", "b.feet", "b.path")
        old = known.select("project_id", "src", "node", F.col("feet").alias("old_ft"))
        front = cut_lineage(better.join(old, ["project_id", "src", "node"], "left").where(F.col("old_ft").isNull() | (F.round("feet", 6) < F.round("old_ft", 6))).drop("old_ft"))
        if front.isEmpty():
            return known
        known = cut_lineage(known.join(front.select("project_id", "src", "node"), ["project_id", "src", "node"], "left_anti").unionByName(front))
    raise RuntimeError("paths did not settle")


def consecutive(snapped: DataFrame, id_col: str, cfg: Snap = Snap()) -> DataFrame:
    """Pairs of points next to each other along the main route, 15 to 650 ft apart."""
    cols = [id_col, "segment_id", "offset_ft", "route_offset_ft"]
    blocked = split_blocks(snapped, ["project_id"], F.floor(F.col("route_offset_ft") / 500))
    order = ["route_offset_ft", id_col]
    placed = with_position(blocked, ["project_id"], order, "place")
    near = with_neighbours(placed, ["project_id"], order, cols)
    pair = near.where("prev IS NOT NULL").select(
        "project_id", "place", F.col("prev").alias("a"), F.struct(*cols).alias("b"), F.round(F.abs(F.col("route_offset_ft") - F.col("prev.route_offset_ft")), 2).alias("gap_ft"))
    return pair.where(F.col("gap_ft").between(cfg.min_length_ft, cfg.max_gap_ft))


def _partial(side: str, end: Column) -> Column:
    """From a snap to one end of its segment."""
    coords, chain, at = F.col(f"{side}_seg.coords"), F.col(f"{side}_seg.chain"), F.col(f"{side}.offset_ft")
    return F.when(end == "start", F.reverse(geo.clip(coords, chain, F.lit(0.0), at))).otherwise(geo.clip(coords, chain, at, F.element_at(chain, -1)))


def built_paths(pairs: DataFrame, noded: DataFrame, id_col: str, cfg: Snap = Snap()) -> DataFrame:
    """Network path of each pair: a slice of one segment, or the cheapest of the four ways
    between the ends of two, with its geometry and length."""
    seg = noded.where("eligible").select(*KEY, F.struct("coords", "chain", "length_ft", "start_node", "end_node").alias("seg"))
    full = pairs.withColumns({"_a": F.col("a.segment_id"), "_b": F.col("b.segment_id")})
    full = full.join(seg.select("project_id", F.col("segment_id").alias("_a"), F.col("seg").alias("a_seg")), ["project_id", "_a"]).join(
        seg.select("project_id", F.col("segment_id").alias("_b"), F.col("seg").alias("b_seg")), ["project_id", "_b"])
    full = cut_lineage(full)
    same = full.where("_a = _b")
    ends = full.where("_a <> _b").withColumn("way", F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(x).alias("s_end"), F.lit(y).alias("e_end")) for n, (x, y) in enumerate((x, y) for x in ("start", "end") for y in ("start", "end"))])))

    def node(side: str, end: str) -> Column:
        return F.when(F.col(f"way.{end}") == "start", F.col(f"{side}_seg.start_node")).otherwise(F.col(f"{side}_seg.end_node"))

    def cost(side: str, end: str) -> Column:
        return F.when(F.col(f"way.{end}") == "start", F.col(f"{side}.offset_ft")).otherwise(
            F.greatest(F.lit(0.0), F.col(f"{side}_seg.length_ft") - F.col(f"{side}.offset_ft")))

    ways = ends.withColumns({"src": node("a", "s_end"), "node": node("b", "e_end"), "own": cost("a", "s_end") + cost("b", "e_end")})
    paths = shortest_paths(edges(noded), ways.select("project_id", F.col("src").alias("node")).distinct(), cfg.max_length_ft)
    priced = ways.join(paths, ["project_id", "src", "node"]).withColumn("total", F.round(F.col("own") + F.col("feet"), 6))
    best = priced.groupBy("project_id", "place").agg(F.min_by(F.struct("way", "path", "total"), F.struct("total", "way.n")).alias("w"))
    chosen = full.where("_a <> _b").join(best, ["project_id", "place"])
    mids = (chosen.select("project_id", "place", F.posexplode("w.path").alias("pos", "segment_id")).join(noded.select(*KEY, "coords"), KEY)
            .groupBy("project_id", "place").agg(F.sort_array(F.collect_list(F.struct("pos", "coords"))).alias("mids")))
    spots = "array<struct<lat:double,lon:double>>"

    def far(p: Column, q: Column) -> Column:
        return geo.haversine_ft(p["lat"], p["lon"], q["lat"], q["lon"])

    def attach(acc: Column, m: Column) -> Column:
        c, end = m["coords"], F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.when(end.isNull() | (far(end, F.get(c, F.lit(0))) <= far(end, F.element_at(c, -1))), c).otherwise(F.reverse(c)))

    head = _partial("a", F.col("w.way.s_end")).cast(spots)
    body = F.aggregate(F.coalesce("mids", F.array().cast(f"array<struct<pos:int,coords:{spots}>>")), head, attach)
    joined = chosen.join(mids, ["project_id", "place"], "left").withColumn("coords", F.concat(body, F.reverse(_partial("b", F.col("w.way.e_end")))))
    crossing = joined.select("project_id", "place", "a", "b", "gap_ft", geo.joined(F.array("coords")).alias("coords"),
                             F.array_sort(F.array_distinct(F.concat(F.array("_a", "_b"), "w.path"))).alias("segment_ids"))
    lo, hi = F.least("a.offset_ft", "b.offset_ft"), F.greatest("a.offset_ft", "b.offset_ft")
    cut = geo.clip(F.col("a_seg.coords"), F.col("a_seg.chain"), lo, hi)
    within = same.select("project_id", "place", "a", "b", "gap_ft", F.when(F.col("a.offset_ft") <= F.col("b.offset_ft"), cut).otherwise(F.reverse(cut)).alias("coords"),
                         F.array("_a").alias("segment_ids"))
    return within.unionByName(crossing).withColumn("length_ft", F.round(geo.length_ft(F.col("coords")), 2))


def field_asbuilt(paths: DataFrame, cfg: Snap = Snap(), rates: Billing = Billing()) -> DataFrame:
    """Paths short enough and not far beyond their own gap, with stations, reason and bill."""
    fit = (F.size("coords") >= 2) & F.col("length_ft").between(cfg.min_length_ft, cfg.max_length_ft) & (F.col("length_ft") <= F.col("gap_ft") * cfg.max_stretch + cfg.stretch_slack_ft)
    lo, hi = F.least("a.route_offset_ft", "b.route_offset_ft"), F.greatest("a.route_offset_ft", "b.route_offset_ft")
    reasons = F.array(*[F.lit(r) for r in REASONS])
    money = [F.round(F.round(F.col("length_ft") * rate, 6), 2).alias(n) for rate, n in (
        (rates.material_rate, "material_cost"), (rates.splicing_rate, "splicing_cost"), (rates.material_rate + rates.splicing_rate, "total_cost"))]
    return paths.where(fit).select(
        "project_id", F.concat(F.lit("AB-"), F.lpad((F.col("place")).cast("string"), 6, "0")).alias("asbuilt_id"), station_label(lo, pad_left=False).alias("start_station"),
        station_label(hi, pad_left=False).alias("end_station"), F.round(lo, 2).alias("start_ft"), F.round(hi, 2).alias("end_ft"), "length_ft",
        F.get(reasons, ((F.col("place") - 1) % len(REASONS)).cast("int")).alias("reason"), "segment_ids", "coords", *money)


def segment_status(segments: DataFrame, snapped: DataFrame, built: DataFrame) -> DataFrame:
    """planned, in_progress, completed or redlined, from snapped points and built paths."""
    seen = snapped.groupBy(*KEY).agg(F.count("*").alias("evidence"))
    share = F.col("length_ft") / F.size("segment_ids")
    done = built.select("project_id", share.alias("feet"), F.explode("segment_ids").alias("segment_id")).groupBy(*KEY).agg(F.sum("feet").alias("built_ft"))
    ratio = F.least(F.lit(1.0), F.coalesce("built_ft", F.lit(0.0)) / F.greatest("length_ft", F.lit(1.0)))
    return (segments.join(seen, KEY, "left").join(done, KEY, "left").withColumn("status", F.when(F.col("built_ft").isNotNull(), "redlined").when(ratio >= 0.8, "completed")
            .when((F.coalesce("evidence", F.lit(0)) > 0) | (ratio > 0.05), "in_progress").otherwise("planned")))


def status_summary(statused: DataFrame) -> DataFrame:
    return statused.groupBy("project_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("length_ft"), 2).alias("feet"))
