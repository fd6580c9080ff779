"""Queries that snap field photos to the network and derive what was built between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import network, routes
from trenchline.plans.check_sql import RAW, hav, sql
from trenchline.plans.inputs import cte, view
from trenchline.plans.queries_geometry import r, raw_chain
from trenchline.plans.registry import query
from trenchline.session import cut_lineage


def segments(spark, sf_dir):
    lines = routes.as_polylines(raw_chain(spark, sf_dir)).join(view(spark, sf_dir, "route_meta"), routes.KEY).select(
        "project_id", F.col("route_id").alias("segment_id"), F.col("route_name").alias("name"), F.lit("").alias("description"), F.lit("").alias("style"), "coords", "chain", "total_ft")
    return network.network_segments(lines)


def photos(spark, sf_dir):
    return view(spark, sf_dir, "gps_fixes").select("project_id", "event_id", "lat", "lon")


_SEG = RAW + [cte("route_meta"), f"""bx AS (SELECT project_id, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM vertices GROUP BY 1)""",
    f"""nl AS (SELECT c.project_id, c.route_id AS segment_id, max(chain) AS total, round(max(chain), 2) AS length_ft, count(*) AS n, arg_min(lat, idx) AS a_lat, arg_min(lon, idx) AS a_lon, arg_max(lat, idx) AS z_lat, arg_max(lon, idx) AS z_lon,
   count(*) FILTER (abs(lat - y0) < 0.0006 OR abs(lat - y1) < 0.0006) + count(*) FILTER (abs(lon - x0) < 0.0006 OR abs(lon - x1) < 0.0006) AS hits FROM ch c JOIN bx USING (project_id) GROUP BY 1, 2)""",
    f"""ns AS (SELECT nl.*, CASE WHEN route_name LIKE 'Underground Cable%' THEN 'fiber_path' WHEN route_name LIKE 'Backbone%' THEN 'backbone' WHEN route_name LIKE 'Terminal Tail%' THEN 'terminal_tail' WHEN route_name LIKE 'Vacant Pipe%' THEN 'vacant_conduit' ELSE 'lateral' END AS segment_type
   FROM nl JOIN route_meta m ON m.project_id = nl.project_id AND m.route_id = segment_id)""",
    f"""nb AS (SELECT *, {hav('a_lat', 'a_lon', 'z_lat', 'z_lon')} < 35 OR (total > 1200 AND hits / (n * 2) > 0.35 AND segment_type IN ('backbone', 'lateral', 'terminal_tail')) AS is_boundary FROM ns)"""]


@query("network_segments", sql(*_SEG, then="""SELECT project_id, segment_id, segment_type, length_ft, CASE WHEN is_boundary THEN 'boundary' ELSE 'network' END AS segment_role, NOT is_boundary AS eligible, is_boundary FROM nb"""))
def network_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("project_id", "segment_id", "segment_type", "length_ft", "segment_role", "eligible", "is_boundary")


@query("network_types", sql(*_SEG, then="SELECT project_id, segment_type, count(*) AS n, round(sum(length_ft), 2) AS feet FROM nb GROUP BY 1, 2"))
def network_types(spark, sf_dir):
    return network.type_summary(segments(spark, sf_dir))


_NODE = "printf('%.4f|%.4f', round({a}, 4), round({b}, 4))"


@query("network_nodes", sql(*_SEG, then=f"""SELECT project_id, node, count(*) AS degree FROM (SELECT project_id, {_NODE.format(a='a_lat', b='a_lon')} AS node FROM nb WHERE NOT is_boundary
  UNION ALL SELECT project_id, {_NODE.format(a='z_lat', b='z_lon')} FROM nb WHERE NOT is_boundary) GROUP BY 1, 2"""))
def network_nodes(spark, sf_dir):
    return network.node_degrees(network.with_nodes(segments(spark, sf_dir)))


@query("network_edges", sql(*_SEG, then=f"""SELECT project_id, segment_id, length_ft, {_NODE.format(a='a_lat', b='a_lon')} AS src, {_NODE.format(a='z_lat', b='z_lon')} AS dst FROM nb WHERE NOT is_boundary
  UNION ALL SELECT project_id, segment_id, length_ft, {_NODE.format(a='z_lat', b='z_lon')}, {_NODE.format(a='a_lat', b='a_lon')} FROM nb WHERE NOT is_boundary"""))
def network_edges(spark, sf_dir):
    return network.edges(network.with_nodes(segments(spark, sf_dir)))


@query("photo_snaps", sql(*_SEG, cte("gps_fixes"), then="""
, lg AS (SELECT s.*, 364000.0 * cos(radians((s.a_lat + s.b_lat) / 2)) AS e, nb.segment_id FROM seg s JOIN nb ON nb.project_id = s.project_id AND nb.segment_id = s.route_id AND NOT is_boundary),
lp AS (SELECT *, sqrt(pow((b_lon - a_lon) * e, 2) + pow((b_lat - a_lat) * 364000.0, 2)) AS pl FROM lg),
lb AS (SELECT *, coalesce(sum(pl) OVER (PARTITION BY project_id, segment_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lp),
sc AS (SELECT f.project_id, event_id, segment_id, seg_idx, lat, lon, a_lat, a_lon, b_lat, b_lon, e, pl, before, least(greatest(((lon - a_lon) * (b_lon - a_lon) * e * e + (lat - a_lat) * (b_lat - a_lat) * 364000.0 * 364000.0) / (pl * pl), 0), 1) AS t
  FROM gps_fixes f JOIN lb ON lb.project_id = f.project_id),
sd AS (SELECT *, sqrt(pow((lon - a_lon - (b_lon - a_lon) * t) * e, 2) + pow((lat - a_lat - (b_lat - a_lat) * t) * 364000.0, 2)) AS d FROM sc)
SELECT project_id, event_id, arg_min(segment_id, (round(d, 6), segment_id, seg_idx)) AS segment_id, round(min(d), 2) AS distance_ft, round(arg_min(before + pl * t, (round(d, 6), segment_id, seg_idx)), 2) AS offset_ft,
  round(greatest(0, 1 - min(d) / 250), 3) AS confidence FROM sd WHERE d <= 250 GROUP BY 1, 2"""))
def photo_snaps(spark, sf_dir):
    return network.snap(photos(spark, sf_dir), segments(spark, sf_dir), "event_id").select(
        "project_id", "event_id", "segment_id", r("distance_ft", 2), r("offset_ft", 2), "confidence")


def built(spark, sf_dir):
    segs = cut_lineage(segments(spark, sf_dir))
    snapped = cut_lineage(network.with_route_offset(network.snap(photos(spark, sf_dir), segs, "event_id"), segs, "event_id"))
    paths = network.built_paths(network.consecutive(snapped, "event_id"), network.with_nodes(segs), "event_id")
    return segs, snapped, network.field_asbuilt(paths)


@query("photo_asbuilt")
def photo_asbuilt(spark, sf_dir):
    return built(spark, sf_dir)[2].withColumns({"n_points": F.size("coords"), "segment_ids": F.array_join("segment_ids", ",")}).drop("coords")


@query("network_status")
def network_status(spark, sf_dir):
    segs, snapped, paths = built(spark, sf_dir)
    return network.status_summary(network.segment_status(segs, snapped, paths))


@query("network_paths")
def network_paths(spark, sf_dir):
    noded = cut_lineage(network.with_nodes(segments(spark, sf_dir)))
    sources = noded.select("project_id", F.explode(F.array("start_node", "end_node")).alias("node")).distinct()
    return network.shortest_paths(network.edges(noded), sources, 5000.0).select("project_id", "src", "node", r("feet", 2), F.size("path").alias("n_segments"))
