"""Queries over phone walks (batch twins of the stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.functions import stations as st
from trenchline.operators import routes, walks
from trenchline.plans.check_sql import RAW, hav, sql
from trenchline.plans.inputs import cte, view
from trenchline.plans.queries_geometry import r, raw_chain
from trenchline.plans.registry import query

GAP_S = 86400.0  # the given events are hours apart, so a walk here ends after a day


def walked(spark, sf_dir):
    fixes = view(spark, sf_dir, "gps_fixes").withColumn("t_s", walks.seconds(F.col("ts")))
    return walks.split_walks(fixes, GAP_S)


_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01 00:00:00')) / 1e6"
_MOVE = hav("a.lat", "a.lon", "n.lat", "n.lon", metres=True)
_WALKS = [cte("gps_fixes"), f"gf AS (SELECT *, {_T} AS t_s FROM gps_fixes)",
          f"wm AS (SELECT *, CASE WHEN lag(t_s) OVER w IS NULL OR t_s - lag(t_s) OVER w > {GAP_S} THEN t_s END AS mark FROM gf WINDOW w AS (PARTITION BY session_id ORDER BY t_s, event_id))",
          "ww AS (SELECT *, max(mark) OVER (PARTITION BY session_id ORDER BY t_s, event_id) AS walk_s FROM wm)",
          "gq AS (SELECT *, row_number() OVER (PARTITION BY session_id, walk_s ORDER BY t_s, event_id) AS n FROM ww WHERE accuracy_m > 0 AND accuracy_m <= 25 AND abs(delay_s) <= 8)",
          f"""ac AS (SELECT session_id, walk_s, n, t_s, event_id, lat, lon, true AS kept, 0 AS pos FROM gq WHERE n = 1
  UNION ALL SELECT n.session_id, n.walk_s, n.n, CASE WHEN k THEN n.t_s ELSE a.t_s END, CASE WHEN k THEN n.event_id ELSE a.event_id END, CASE WHEN k THEN n.lat ELSE a.lat END, CASE WHEN k THEN n.lon ELSE a.lon END, k, a.pos + CAST(k AS INT)
  FROM ac a JOIN gq n ON n.session_id = a.session_id AND n.walk_s = a.walk_s AND n.n = a.n + 1, LATERAL (SELECT {_MOVE} >= 1.5 AND n.t_s - a.t_s >= 2 AS k) x)"""]


def wsql(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([*_WALKS, *parts]) + "\n" + then


@query("accepted_fixes", wsql(then="SELECT session_id, round(walk_s, 3) AS walk_s, pos, event_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM ac WHERE kept"))
def accepted_fixes(spark, sf_dir):
    return walks.accept_fixes(walked(spark, sf_dir)).select("session_id", r("walk_s", 3), "pos", "event_id", r("lat", 7), r("lon", 7))


@query("walk_sessions", wsql(then="SELECT session_id, round(walk_s, 3) AS walk_s, round(max(t_s), 3) AS ended_s, count(*) AS n_fixes FROM ww GROUP BY 1, 2"))
def walk_sessions(spark, sf_dir):
    return walks.walk_sessions(walked(spark, sf_dir)).select("session_id", r("walk_s", 3), r("ended_s", 3), "n_fixes")


def trail(spark, sf_dir):
    sessions = view(spark, sf_dir, "gps_fixes").select("session_id", "project_id", "route_id").distinct()
    return walks.snapped_trail(walks.accept_fixes(walked(spark, sf_dir)), sessions, routes.as_polylines(raw_chain(spark, sf_dir)))


_SNAP = [*RAW, """ss AS (SELECT DISTINCT session_id, project_id, route_id FROM gps_fixes)""",
         f"""sp AS (SELECT a.session_id, a.walk_s, a.pos, a.event_id, a.lat AS plat, a.lon AS plon, s.*, cos(radians(v.lat)) AS e FROM ac a JOIN ss USING (session_id) JOIN seg s ON s.project_id = ss.project_id AND s.route_id = ss.route_id
   JOIN vertices v ON v.project_id = ss.project_id AND v.route_id = ss.route_id AND v.idx = 0 WHERE kept)""",
         """sq AS (SELECT *, CASE WHEN pow((b_lon - a_lon) * e, 2) + pow(b_lat - a_lat, 2) > 1e-12 THEN least(1, greatest(0, ((plon - a_lon) * (b_lon - a_lon) * e * e + (plat - a_lat) * (b_lat - a_lat)) / (pow((b_lon - a_lon) * e, 2) + pow(b_lat - a_lat, 2)))) ELSE 0 END AS t FROM sp)""",
         f"""sx AS (SELECT *, a_lat + (b_lat - a_lat) * t AS qy, a_lon + (b_lon - a_lon) * t AS qx, start_ft + t * (end_ft - start_ft) AS ft FROM sq)""",
         f"""sy AS (SELECT *, round({hav('plat', 'plon', 'qy', 'qx')}, 6) AS d FROM sx QUALIFY row_number() OVER (PARTITION BY session_id, walk_s, pos ORDER BY d, seg_idx) = 1)"""]


@query("snapped_trails", wsql(*_SNAP, then="SELECT session_id, event_id, round(d, 2) AS distance_ft, round(ft, 2) AS route_ft, round(qy, 7) AS snap_lat, round(qx, 7) AS snap_lon FROM sy"))
def snapped_trails(spark, sf_dir):
    return trail(spark, sf_dir).select("session_id", "event_id", "distance_ft", "route_ft", r("snap_lat", 7), r("snap_lon", 7))


@query("walk_entries", wsql("""en AS (SELECT session_id, t_s + 30 AS t_s, event_id AS entry_id, concat(event_id % 30, '+', lpad(CAST(event_id % 100 AS VARCHAR), 2, '0')) AS station_text FROM gf)""",
                            """ak AS (SELECT * FROM ac WHERE kept)""", then="""
SELECT e.session_id, e.entry_id, CAST(CAST(split_part(station_text, '+', 1) AS BIGINT) * 100 + CAST(split_part(station_text, '+', 2) AS BIGINT) AS DOUBLE) AS station_ft, a.event_id AS fix_id, round(a.lat, 7) AS lat, round(a.lon, 7) AS lon
FROM en e ASOF LEFT JOIN ak a ON a.session_id = e.session_id AND e.t_s >= a.t_s"""))
def walk_entries(spark, sf_dir):
    fixes = walked(spark, sf_dir)
    eid = F.col("event_id")
    entries = fixes.select("session_id", (F.col("t_s") + 30).alias("t_s"), eid.alias("entry_id"),
                           F.concat(eid % 30, F.lit("+"), F.lpad((eid % 100).cast("string"), 2, "0")).alias("station_text"), F.lit("n").alias("note"))
    found = walks.located_entries(entries, walks.accept_fixes(fixes))
    return found.select("session_id", "entry_id", st.feet_from_station(F.col("station_text")).alias("station_ft"), "fix_id", r("lat", 7), r("lon", 7))


_EAST = "(radians(1) * 6371000 * greatest(cos(radians(k.lat)), 0.01))"
_NORTH = "(radians(1) * 6371000)"


def apart(a: str, b: str) -> str:
    return hav(f"{a}lat", f"{a}lon", f"{b}lat", f"{b}lon", metres=True)


_STEADY = [*_SNAP,
           """zt AS (SELECT session_id, walk_s, pos, qy AS lat, qx AS lon, row_number() OVER w AS n, count(*) OVER (PARTITION BY session_id, walk_s) AS total, lead(qy) OVER w AS after_lat, lead(qx) OVER w AS after_lon
   FROM sy WINDOW w AS (PARTITION BY session_id, walk_s ORDER BY pos))""",
           f"""zk AS (SELECT session_id, walk_s, pos, n, true AS kept, lat, lon FROM zt WHERE n = 1
  UNION ALL SELECT z.session_id, z.walk_s, z.pos, z.n, keep, CASE WHEN keep THEN z.lat ELSE k.lat END, CASE WHEN keep THEN z.lon ELSE k.lon END
  FROM zk k JOIN zt z ON z.session_id = k.session_id AND z.walk_s = k.walk_s AND z.n = k.n + 1,
       LATERAL (SELECT (z.lon - k.lon) * {_EAST} AS ux, (z.lat - k.lat) * {_NORTH} AS uy, (z.after_lon - k.lon) * {_EAST} AS vx, (z.after_lat - k.lat) * {_NORTH} AS vy) v,
       LATERAL (SELECT CASE WHEN sqrt(vx * vx + vy * vy) < 0.35 THEN sqrt(ux * ux + uy * uy) ELSE abs(ux * vy - uy * vx) / sqrt(vx * vx + vy * vy) END AS off,
                       CASE WHEN vx * vx + vy * vy < 1e-6 THEN 0.5 ELSE (ux * vx + uy * vy) / (vx * vx + vy * vy) END AS t) o,
       LATERAL (SELECT {apart('k.', 'z.')} AS ab, {apart('z.', 'z.after_')} AS bc, {apart('k.', 'z.after_')} AS ac) m,
       LATERAL (SELECT z.n = z.total OR NOT (off <= 2.8 AND t >= 0.04 AND t <= 0.96 AND ab <= 14 AND bc <= 14 AND ab + bc <= m.ac + 1.8) AS keep) x)""",
           """ze AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM zk WHERE kept WINDOW w AS (PARTITION BY session_id, walk_s ORDER BY pos))""",
           "zm AS (SELECT *, p_lat * 0.22 + lat * 0.56 + n_lat * 0.22 AS to_lat, p_lon * 0.22 + lon * 0.56 + n_lon * 0.22 AS to_lon FROM ze)",
           f"zo AS (SELECT *, coalesce({apart('', 'to_')} <= 2.2, false) AS eased FROM zm)"]


@query("steady_trails", wsql(*_STEADY, then="""SELECT session_id, round(walk_s, 3) AS walk_s, pos,
       round(CASE WHEN eased THEN to_lat ELSE lat END, 7) AS lat, round(CASE WHEN eased THEN to_lon ELSE lon END, 7) AS lon FROM zo"""))
def steady_trails(spark, sf_dir):
    snapped = trail(spark, sf_dir).select(*walks.WALK, "pos", F.col("snap_lat").alias("lat"), F.col("snap_lon").alias("lon"))
    return walks.steady_trail(snapped).select("session_id", r("walk_s", 3), "pos", r("lat", 7), r("lon", 7))
