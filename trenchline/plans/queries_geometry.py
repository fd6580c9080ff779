"""Queries over route geometry and linear referencing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.operators import hulls, routes
from trenchline.operators.clipping import clip
from trenchline.plans.check_sql import RAW, ROUTES, chained, hav, sql
from trenchline.plans.inputs import cte, view, with_views
from trenchline.plans.registry import query
from trenchline.sources import design

KEY = routes.KEY


def raw_chain(spark, sf_dir):
    return routes.with_chainage(routes.clean_vertices(view(spark, sf_dir, "vertices")))


def catalog(spark, sf_dir):
    return routes.build_catalog(view(spark, sf_dir, "vertices"), view(spark, sf_dir, "route_meta"))


def r(name, digits, alias=None):
    return F.round(F.col(name), digits).alias(alias or name.split(".")[-1])


@query("route_chainage", sql(*RAW, then="SELECT project_id, route_id, idx, round(step, 4) AS step_ft, round(chain, 4) AS chain_ft FROM ch"))
def route_chainage(spark, sf_dir):
    return raw_chain(spark, sf_dir).select(*KEY, "idx", r("step_ft", 4), r("chain_ft", 4))


@query("route_catalog", sql(*ROUTES, then="""
SELECT project_id, route_id, route_name, source_folder, route_role, length_ft, point_count, catalog_rank FROM catalog_"""))
def route_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        *KEY, "route_name", "source_folder", "route_role", "length_ft", "point_count", "catalog_rank")


@query("default_routes", sql(*ROUTES, then="""
SELECT project_id, route_id, route_name, length_ft FROM catalog_ WHERE catalog_rank = 1"""))
def default_routes(spark, sf_dir):
    return routes.default_routes(catalog(spark, sf_dir))


@query("densified_vertices", sql(*ROUTES, then="""
SELECT project_id, route_id, row_number() OVER (PARTITION BY project_id, route_id ORDER BY idx) - 1 AS idx,
  round(lat, 7) AS lat, round(lon, 7) AS lon FROM dense"""))
def densified_vertices(spark, sf_dir):
    return routes.densify(raw_chain(spark, sf_dir)).select(*KEY, "idx", r("lat", 7), r("lon", 7))


@query("virtual_segments", sql(*ROUTES, then="""
SELECT project_id, route_id, seg_idx, round(start_ft, 3) AS start_ft, round(end_ft, 3) AS end_ft, n_chunks, chunk_base FROM dseg"""))
def virtual_segments(spark, sf_dir):
    dense = routes.with_chainage(routes.densify(raw_chain(spark, sf_dir)))
    return routes.route_segments(dense).select(*KEY, "seg_idx", r("start_ft", 3), r("end_ft", 3), "n_chunks", "chunk_base")


@query("simple_routes", with_views("vertices", then=f"""
, m AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', metres=True)} AS step FROM vertices
  WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx))
SELECT project_id, route_id, count(*) AS n_points, 0 AS start_station, CAST(floor(sum(step) / 0.3048 + 1e-9) AS INT) AS end_station
FROM m GROUP BY 1, 2 HAVING count(*) >= 3 AND CAST(floor(sum(step) / 0.3048 + 1e-9) AS INT) > 50"""))
def simple_routes(spark, sf_dir):
    return routes.simple_routes(view(spark, sf_dir, "vertices"))


@query("session_route_boxes", with_views("vertices", "gps_fixes", then="""
, rb AS (SELECT project_id, route_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d, avg(lat) AS cy, avg(lon) AS cx FROM vertices GROUP BY 1, 2),
sb AS (SELECT project_id, session_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM gps_fixes GROUP BY 1, 2)
SELECT s.project_id, session_id, r.route_id, round(cy, 6) AS c_lat, round(cx, 6) AS c_lon FROM sb s JOIN rb r ON r.project_id = s.project_id
WHERE r.b >= s.a - 0.0005 AND r.a <= s.b + 0.0005 AND r.d >= s.c - 0.0005 AND r.c <= s.d + 0.0005"""))
def session_route_boxes(spark, sf_dir):
    route_boxes = routes.bounds(view(spark, sf_dir, "vertices"), KEY).withColumnRenamed("box", "route_box")
    boxes = routes.bounds(view(spark, sf_dir, "gps_fixes"), ["project_id", "session_id"]).select("project_id", "session_id", "box")
    touch = geo.boxes_touch(F.col("box"), F.col("route_box"), F.lit(0.0005), F.lit(0.0005))
    return boxes.join(route_boxes, "project_id").where(touch).select(
        "project_id", "session_id", "route_id", r("c_lat", 6), r("c_lon", 6))


_STATIONS = """, pts AS (SELECT b.project_id, concat('route_', split_part(b.source_file, '_', 3)) AS route_id, source_file, print, station,
  CAST(split_part(station, '+', 1) AS DOUBLE) * 100 + CAST(split_part(station, '+', 2) AS DOUBLE) AS ft FROM bore_rows b),
rel AS (SELECT *, ft - min(ft) OVER (PARTITION BY project_id, source_file) AS at_ft FROM pts)"""


@query("station_locations", sql(*RAW, cte("bore_rows"), then=_STATIONS + """
, tot AS (SELECT project_id, route_id, max(end_ft) AS t FROM seg GROUP BY 1, 2),
d AS (SELECT r.*, least(at_ft, t) AS d FROM rel r JOIN tot USING (project_id, route_id)),
x AS (SELECT d.*, s.*, (d - start_ft) / (end_ft - start_ft) AS ratio FROM d JOIN seg s ON s.project_id = d.project_id AND s.route_id = d.route_id
  AND ((d > start_ft) OR (d = 0 AND seg_idx = 0)) AND d <= end_ft)
SELECT project_id, route_id, source_file, print, station, at_ft, seg_idx, round(ratio, 5) AS ratio,
  chunk_base + least(n_chunks - 1, CAST(floor(ratio * n_chunks) AS INT)) AS virtual_idx,
  round(a_lat + (b_lat - a_lat) * ratio, 7) AS lat, round(a_lon + (b_lon - a_lon) * ratio, 7) AS lon FROM x"""))
def station_locations(spark, sf_dir):
    from trenchline.operators.quality import relative_progress
    from trenchline.sources.bore_logs import clean_bore_rows

    rows = clean_bore_rows(view(spark, sf_dir, "bore_rows")).withColumn(
        "route_id", F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1)))
    points = relative_progress(rows, ["project_id", "source_file"]).select(*KEY, "source_file", "print", "station", "at_ft")
    return routes.locate(points, routes.route_segments(raw_chain(spark, sf_dir))).select(
        *points.columns, "seg_idx", r("ratio", 5), "virtual_idx", r("lat", 7), r("lon", 7))


_AT = """(SELECT project_id, route_id, start_ft AS f, {c} AS d, row_number() OVER () AS n FROM k)"""


@query("clipped_stretches", sql(*RAW, cte("built"), then="""
, k AS (SELECT DISTINCT project_id, route_id, start_ft AS s0, end_ft AS e0 FROM built),
kk AS (SELECT k.*, least(s0, t) AS s, least(e0, t) AS e FROM k JOIN (SELECT project_id, route_id, max(end_ft) AS t FROM seg GROUP BY 1, 2) USING (project_id, route_id)),
mid AS (SELECT project_id, route_id, s0, e0, count(*) AS n FROM kk JOIN ch USING (project_id, route_id) WHERE chain > s AND chain < e GROUP BY ALL),
p AS (SELECT kk.*, a_lat + (b_lat - a_lat) * (s - start_ft) / (end_ft - start_ft) AS s_lat, a_lon + (b_lon - a_lon) * (s - start_ft) / (end_ft - start_ft) AS s_lon
  FROM kk JOIN seg USING (project_id, route_id) WHERE e > s AND (s > start_ft OR (s = 0 AND seg_idx = 0)) AND s <= end_ft),
q AS (SELECT kk.*, a_lat + (b_lat - a_lat) * (e - start_ft) / (end_ft - start_ft) AS e_lat, a_lon + (b_lon - a_lon) * (e - start_ft) / (end_ft - start_ft) AS e_lon
  FROM kk JOIN seg USING (project_id, route_id) WHERE e > s AND e > start_ft AND e <= end_ft)
SELECT kk.project_id, kk.route_id, kk.s0 AS start_ft, kk.e0 AS end_ft, CASE WHEN kk.e > kk.s THEN 2 + coalesce(mid.n, 0) ELSE 0 END AS n_points,
  round(s_lat, 7) AS s_lat, round(s_lon, 7) AS s_lon, round(e_lat, 7) AS e_lat, round(e_lon, 7) AS e_lon
FROM kk LEFT JOIN mid USING (project_id, route_id, s0, e0) LEFT JOIN p USING (project_id, route_id, s0, e0) LEFT JOIN q USING (project_id, route_id, s0, e0)"""))
def clipped_stretches(spark, sf_dir):
    keys = view(spark, sf_dir, "built").select(*KEY, "start_ft", "end_ft").distinct()
    lines = routes.as_polylines(raw_chain(spark, sf_dir))
    cut = keys.join(lines, KEY).withColumn("c", clip("coords", "chain", "start_ft", "end_ft"))
    first, last = F.get("c", F.lit(0)), F.try_element_at("c", F.lit(-1))
    return cut.select(*KEY, "start_ft", "end_ft", F.size("c").alias("n_points"),
                      F.round(first["lat"], 7).alias("s_lat"), F.round(first["lon"], 7).alias("s_lon"),
                      F.round(last["lat"], 7).alias("e_lat"), F.round(last["lon"], 7).alias("e_lon"))


@query("whole_segment_slices", sql(*RAW, cte("built"), then="""
, k AS (SELECT DISTINCT project_id, route_id, start_ft AS s, end_ft AS e FROM built),
hit AS (SELECT k.*, seg_idx FROM k JOIN seg USING (project_id, route_id) WHERE end_ft >= s AND start_ft <= e)
SELECT k.project_id, k.route_id, k.s AS start_ft, k.e AS end_ft, CASE WHEN count(seg_idx) = 0 THEN 0 ELSE count(seg_idx) + 1 END AS n_points
FROM k LEFT JOIN hit USING (project_id, route_id, s, e) GROUP BY ALL"""))
def whole_segment_slices(spark, sf_dir):
    keys = view(spark, sf_dir, "built").select(*KEY, "start_ft", "end_ft").distinct()
    lines = routes.as_polylines(raw_chain(spark, sf_dir))
    cut = geo.slice_whole(F.col("coords"), F.col("chain"), F.col("start_ft"), F.col("end_ft"))
    return keys.join(lines, KEY).select(*KEY, "start_ft", "end_ft", F.size(cut).alias("n_points"))


@query("even_resample", with_views("vertices", then="""
, l AS (SELECT *, first(lat) OVER w AS lat0, first(lon) OVER w AS lon0 FROM vertices WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)),
xy AS (SELECT *, (lon - lon0) * 111320.0 * cos(radians(lat0)) AS x, (lat - lat0) * 111320.0 AS y FROM l),
legs AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS len FROM (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay FROM xy
  WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)) WHERE ax IS NOT NULL),
cum AS (SELECT *, e - len AS s FROM (SELECT *, sum(len) OVER (PARTITION BY project_id, route_id ORDER BY idx) AS e FROM legs)),
ks AS (SELECT project_id, route_id, lat0, unnest(range(0, CAST(floor((max(e) + 0.001) / 7.62) AS BIGINT) + 1)) AS k FROM cum GROUP BY 1, 2, 3),
own AS (SELECT ks.k, c.*, row_number() OVER (PARTITION BY ks.project_id, ks.route_id, ks.k ORDER BY c.idx) AS n FROM ks
  JOIN (SELECT *, max(e) OVER (PARTITION BY project_id, route_id) AS t FROM cum) c USING (project_id, route_id) WHERE ks.k * 7.62 <= c.e + 1e-9 OR c.e = c.t)
SELECT project_id, route_id, k, k * 25.0 AS station_ft, round(lat0 + (ay + (y - ay) * least(greatest((k * 7.62 - s) / len, 0), 1)) / 111320.0, 7) AS lat,
  round(lon0 + (ax + (x - ax) * least(greatest((k * 7.62 - s) / len, 0), 1)) / (111320.0 * cos(radians(lat0))), 7) AS lon,
  round((x - ax) / len, 6) AS tangent_x, round(-(y - ay) / len, 6) AS normal_x FROM own WHERE n = 1"""))
def even_resample(spark, sf_dir):
    return routes.resample(routes.clean_vertices(view(spark, sf_dir, "vertices"))).select(
        *KEY, "k", "station_ft", r("lat", 7), r("lon", 7), r("tangent_x", 6), r("normal_x", 6))


@query("fix_route_distance", sql(*RAW, cte("gps_fixes"), then="""
, s AS (SELECT f.event_id, seg.*, f.lat AS plat, f.lon AS plon, 364000.0 * greatest(0.2, cos(radians((f.lat + a_lat + b_lat) / 3))) AS e1,
  364000.0 * cos(radians((a_lat + b_lat) / 2)) AS e2 FROM gps_fixes f JOIN seg USING (project_id, route_id)),
t AS (SELECT *, least(greatest(((plon - a_lon) * (b_lon - a_lon) * e1 * e1 + (plat - a_lat) * (b_lat - a_lat) * 364000.0 * 364000.0)
    / (pow((b_lon - a_lon) * e1, 2) + pow((b_lat - a_lat) * 364000.0, 2)), 0), 1) AS t1,
  least(greatest(((plon - a_lon) * (b_lon - a_lon) * e2 * e2 + (plat - a_lat) * (b_lat - a_lat) * 364000.0 * 364000.0)
    / (pow((b_lon - a_lon) * e2, 2) + pow((b_lat - a_lat) * 364000.0, 2)), 0), 1) AS t2,
  sqrt(pow((b_lon - a_lon) * e2, 2) + pow((b_lat - a_lat) * 364000.0, 2)) AS planar FROM s),
u AS (SELECT *, sqrt(pow((plon - a_lon - (b_lon - a_lon) * t1) * e1, 2) + pow((plat - a_lat - (b_lat - a_lat) * t1) * 364000.0, 2)) AS d1,
  sqrt(pow((plon - a_lon - (b_lon - a_lon) * t2) * e2, 2) + pow((plat - a_lat - (b_lat - a_lat) * t2) * 364000.0, 2)) AS d2,
  coalesce(sum(planar) OVER (PARTITION BY event_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT event_id, round(min(d1), 3) AS route_ft, round(min(d2), 3) AS distance_ft, round(arg_min(before + planar * t2, (round(d2, 6), seg_idx)), 3) AS offset_ft,
  round(arg_min(a_lat + (b_lat - a_lat) * t2, (round(d2, 6), seg_idx)), 7) AS snap_lat FROM u GROUP BY 1"""))
def fix_route_distance(spark, sf_dir):
    segs = routes.route_segments(raw_chain(spark, sf_dir))
    fixes = view(spark, sf_dir, "gps_fixes").select(
        "event_id", *KEY, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = routes.nearest_on_route(fixes, segs, ["event_id"])
    d = geo.point_segment_ft(*[F.col(c) for c in ("p_lat", "p_lon", "a_lat", "a_lon", "b_lat", "b_lon")])
    least = fixes.join(segs, KEY).groupBy("event_id").agg(F.min(d).alias("route_ft"))
    return near.join(least, "event_id").select("event_id", r("route_ft", 3), r("distance_ft", 3), r("offset_ft", 3), r("snap_lat", 7))


_BEAR = ("((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) "
         "* cos(radians({d} - {b})))) + 360.0) % 360.0)")


@query("terminal_bearings", sql(*ROUTES, then=f"""
, o AS (SELECT project_id, route_id, list(lat ORDER BY idx) AS la, list(lon ORDER BY idx) AS lo FROM dense GROUP BY 1, 2)
SELECT project_id, route_id, round({_BEAR.format(a='la[1]', b='lo[1]', c='la[2]', d='lo[2]')}, 3) AS start_bearing,
  round({_BEAR.format(a='la[-2]', b='lo[-2]', c='la[-1]', d='lo[-1]')}, 3) AS end_bearing FROM o"""))
def terminal_bearings(spark, sf_dir):
    return routes.terminal_bearings(catalog(spark, sf_dir)).select(*KEY, r("start_bearing", 3), r("end_bearing", 3))


@query("route_bends", sql(*RAW, then="""
, h AS (SELECT *, atan2((lat - lag(lat) OVER w) * 364000.0, (lon - lag(lon) OVER w) * 364000.0 * cos(radians(first(lat) OVER w))) AS heading FROM ch
  WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)),
b AS (SELECT *, abs(degrees(lead(heading) OVER w - heading)) AS t FROM h WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx))
SELECT project_id, route_id, idx, round(chain, 3) AS at_ft, round(CASE WHEN t > 180 THEN abs(t - 360) ELSE t END, 3) AS bend_deg FROM b
WHERE CASE WHEN t > 180 THEN abs(t - 360) ELSE t END >= 12"""))
def route_bends(spark, sf_dir):
    return routes.bends(raw_chain(spark, sf_dir)).select(*KEY, "idx", r("at_ft", 3), r("bend_deg", 3))


@query("turn_penalty", sql(*RAW, then="""
, n AS (SELECT *, lag(lat) OVER w - lat AS ux, lag(lon) OVER w - lon AS uy, lead(lat) OVER w - lat AS vx, lead(lon) OVER w - lon AS vy FROM ch
  WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)),
a AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) AS ang FROM n)
SELECT project_id, route_id, count(*) FILTER (ang >= 25) AS turns, round(count(*) FILTER (ang >= 25) / greatest(max(chain) / 500.0, 1.0), 2) AS penalty
FROM a GROUP BY 1, 2"""))
def turn_penalty(spark, sf_dir):
    return routes.turn_penalty(raw_chain(spark, sf_dir)).select(*KEY, "turns", "penalty")


@query("offset_lines", with_views("vertices", then="""
, n AS (SELECT *, coalesce(lead(lat) OVER w, lag(lat) OVER w) - lat AS dy, coalesce(lead(lon) OVER w, lag(lon) OVER w) - lon AS dx FROM vertices
  WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx))
SELECT project_id, route_id, idx, round(lat + dx / sqrt(dx * dx + dy * dy) * 0.00008, 7) AS lat,
  round(lon - dy / sqrt(dx * dx + dy * dy) * 0.00008, 7) AS lon FROM n"""))
def offset_lines(spark, sf_dir):
    lines = routes.as_polylines(raw_chain(spark, sf_dir))
    moved = lines.select(*KEY, F.posexplode(geo.offset_line(F.col("coords"), 0.00008)).alias("idx", "p"))
    return moved.select(*KEY, "idx", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


@query("joined_lines", with_views("vertices", then="""
, n AS (SELECT project_id, CAST(split_part(route_id, '_', 2) AS INT) AS s, count(*) AS n, arg_max(lon, idx) AS last_lon, arg_max(lat, idx) AS last_lat FROM vertices GROUP BY 1, 2)
SELECT a.project_id, a.s AS route_no, a.n + b.n - 1 AS n_joined, a.n + b.n - 1 AS n_merged, round(b.last_lat, 7) AS first_lat, round(b.last_lon, 7) AS first_lon
FROM n a JOIN n b ON b.s = a.s + 1 AND a.s % 2 = 0"""))
def joined_lines(spark, sf_dir):
    lines = routes.as_polylines(raw_chain(spark, sf_dir)).withColumn("n", F.element_at(F.split("route_id", "_"), 2).cast("int"))
    pair = lines.groupBy("project_id", (F.col("n") - F.col("n") % 2).alias("route_no")).agg(
        F.sort_array(F.collect_list(F.struct("n", "coords"))).alias("p"))
    parts = F.transform("p", lambda x: x["coords"])
    both = pair.where(F.size("p") == 2).withColumns({"j": geo.joined(parts), "m": geo.merged(parts)})
    back = F.get(F.reverse("j"), F.lit(0))
    return both.select("project_id", "route_no", F.size("j").alias("n_joined"), F.size("m").alias("n_merged"),
                       F.round(back["lat"], 7).alias("first_lat"), F.round(back["lon"], 7).alias("first_lon"))


@query("design_outlines")
def design_outlines(spark, sf_dir):
    out = hulls.design_outline(view(spark, sf_dir, "vertices"))
    return out.select("project_id", "pos", r("lat", 7), r("lon", 7))


@query("geojson_summary", with_views("vertices", then="""
SELECT project_id, count(DISTINCT route_id) AS route_count, count(*) AS point_count, min(lon) AS min_lon, min(lat) AS min_lat,
  max(lon) AS max_lon, max(lat) AS max_lat FROM vertices GROUP BY 1"""))
def geojson_summary(spark, sf_dir):
    return design.geojson_summary(view(spark, sf_dir, "vertices"))


def _documents(spark, sf_dir):
    """One map document per route, made of its own exported placemark."""
    from trenchline.functions import text as tx

    lines = routes.as_polylines(raw_chain(spark, sf_dir)).join(view(spark, sf_dir, "route_meta"), KEY)
    role = tx.route_role(F.col("source_folder"), F.col("route_name"))
    mark = design.placemark_text(F.col("route_name"), "designLineStyle", "line", F.col("coords"))
    area = design.placemark_text(F.concat(F.col("route_name"), F.lit(" Area")), "shadowPolyStyle", "polygon", geo.ring(F.slice("coords", 1, 4)))
    spot = design.placemark_text(F.lit("AP-1"), "stationStyle", "point", F.slice("coords", 1, 1))
    text = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Job</name><Folder><name>'), F.col("source_folder"),
                    F.lit("</name>"), mark, area, spot, F.lit("</Folder></Document></kml>"))
    return lines.select(F.concat("project_id", F.lit("/"), "route_id", F.lit(".kml")).alias("path"), role.alias("role"),
                        text.cast("binary").alias("content"))


_FEATURES = sql(*RAW, cte("route_meta"), then="""
, m AS (SELECT *, concat(project_id, '/', route_id, '.kml') AS path, lower(concat(source_folder, ' ', route_name)) AS h FROM route_meta),
f AS (SELECT path, 'line' AS kind, 1 AS n, route_name AS name, source_folder AS folder_path, h, len, pts FROM m
    JOIN (SELECT project_id, route_id, round(max(chain), 2) AS len, count(*) AS pts FROM ch GROUP BY 1, 2) USING (project_id, route_id)
  UNION ALL SELECT path, 'polygon', 2, concat(route_name, ' Area'), source_folder, concat(h, ' area'), NULL, 5 FROM m
  UNION ALL SELECT path, 'point', 3, 'AP-1', source_folder, lower(concat(source_folder, ' ap-1')), NULL, 1 FROM m)
""")
_FEATURE_ROLE = """CASE WHEN contains(h, 'backbone') THEN 'backbone' WHEN contains(h, 'terminal tail') THEN 'terminal_tail'
  WHEN contains(h, 'house drop') THEN 'house_drop' WHEN contains(h, 'vacant') THEN 'vacant_pipe'
  WHEN contains(h, 'underground cable') THEN 'underground_cable' ELSE 'other' END"""


@query("design_features", _FEATURES + f"""SELECT path, concat(kind, '_', n) AS feature_id, kind, name, folder_path, {_FEATURE_ROLE} AS role,
  len AS length_ft, CAST(pts AS INT) AS n_points FROM f""")
def design_features(spark, sf_dir):
    found = design.design_features(design.placemarks(_documents(spark, sf_dir)))
    return found.select("path", "feature_id", "kind", "name", "folder_path", "role", "length_ft", F.size("coords").alias("n_points"))


@query("design_facets", _FEATURES + f"""SELECT path, facet, label, count(*) AS n_features FROM (
  SELECT path, 'folder' AS facet, folder_path AS label FROM f UNION ALL SELECT path, 'line_role', {_FEATURE_ROLE} FROM f WHERE kind = 'line'
  UNION ALL SELECT path, 'point_role', {_FEATURE_ROLE} FROM f WHERE kind = 'point') GROUP BY 1, 2, 3""")
def design_facets(spark, sf_dir):
    return design.feature_counts(design.design_features(design.placemarks(_documents(spark, sf_dir))))


@query("main_routes", _FEATURES + "SELECT path, CAST(pts AS INT) AS n_points, 1 AS n_candidates FROM f WHERE kind = 'line'")
def main_routes(spark, sf_dir):
    return design.main_route(design.placemarks(_documents(spark, sf_dir))).select(
        "path", F.size("coords").alias("n_points"), "n_candidates")


@query("polygon_override", _FEATURES + """SELECT path, kind, concat(name, CASE WHEN kind = 'polygon' AND contains(h, 'zone1') THEN ' v2' ELSE '' END) AS name FROM f""")
def polygon_override(spark, sf_dir):
    found = design.design_features(design.placemarks(_documents(spark, sf_dir)))
    second = found.where(F.contains("folder_path", F.lit("Zone1"))).withColumn("name", F.concat("name", F.lit(" v2")))
    return design.replace_polygons(found, second).select("path", "kind", "name")


@query("route_geojson", sql(*RAW, then="""
SELECT project_id, route_id, concat('{"type":"Feature","properties":{"route_id":"', route_id, '","construction_type":"PLAN"},"geometry":{"type":"LineString","n":',
  count(*), '}}') AS feature FROM ch GROUP BY 1, 2"""))
def route_geojson(spark, sf_dir):
    lines = routes.as_polylines(raw_chain(spark, sf_dir))
    text = design.line_geojson(F.col("coords"), F.struct("route_id", F.lit("PLAN").alias("construction_type")))
    # floats print differently per engine, so the check sees the point count in their place
    n = F.size(F.from_json(F.get_json_object(text, "$.geometry.coordinates"), "array<array<double>>"))
    return lines.select(*KEY, F.regexp_replace(text, r'"coordinates":.*\]\]', F.concat(F.lit('"n":'), n.cast("string"))).alias("feature"))


@query("coordinate_text", with_views("vertices", then="""
SELECT project_id, route_id, idx, lat, lon FROM vertices"""))
def coordinate_text(spark, sf_dir):
    from trenchline.functions import text as tx

    lines = routes.as_polylines(raw_chain(spark, sf_dir))
    noisy = F.concat(geo.coord_text(F.col("coords")), F.lit(" bad x,y 7"))
    return lines.select(*KEY, F.posexplode(tx.coordinate_text(noisy)).alias("idx", "p")).select(*KEY, "idx", "p.lat", "p.lon")
