"""Queries that clean and check log rows in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.functions import stations as st
from trenchline.operators import quality, routes
from trenchline.plans.check_sql import RAW, hav, sql
from trenchline.plans.inputs import cte, view, with_views
from trenchline.plans.queries_geometry import raw_chain
from trenchline.plans.queries_text import _SCAN_FROM, _SCAN_TO, feet_sql, number_sql, scan_sql
from trenchline.plans.registry import query
from trenchline.session import new_path
from trenchline.sources import bore_logs as src
from trenchline.sources import exports, stores

TABLE = ["table_id"]


def cells(spark, sf_dir):
    raw = view(spark, sf_dir, "cells").withColumn("_s", st.station_scan(F.col("station_raw")))
    return raw.withColumns({"station_ft": st.feet_from_station(F.col("_s")),
                            "depth_ft": st.number(F.col("depth_raw")), "boc_ft": st.number(F.col("boc_raw"))}).drop("_s")


_CELLS = cte("cells") + f""", cl AS (SELECT table_id, row_index, source_file, {feet_sql(scan_sql('station_raw'))} AS v,
  {number_sql('depth_raw')} AS depth_ft, {number_sql('boc_raw')} AS boc_ft, notes FROM cells),
nx AS (SELECT *, first(v IGNORE NULLS) OVER f AS nv, first(CASE WHEN v IS NOT NULL THEN row_index END IGNORE NULLS) OVER f AS np FROM cl
  WINDOW f AS (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
vl AS (SELECT table_id, list(v ORDER BY row_index) FILTER (v IS NOT NULL) AS vs FROM cl GROUP BY 1),
df AS (SELECT table_id, vs, list_filter([abs(vs[i + 1] - vs[i]) for i in range(1, coalesce(len(vs), 0))], lambda d: d > 0) AS ds FROM vl),
st AS (SELECT table_id, vs, coalesce(len(vs), 0) AS nvs, coalesce(len(ds), 0) AS nds,
  list_sort([{{'o': abs(ds[i] - 50), 'i': i, 'd': ds[i]}} for i in range(1, coalesce(len(ds), 0) + 1)])[1].d AS near FROM df)
"""

_FILL_NOW = """, r AS (SELECT n.table_id, n.row_index, CASE WHEN v IS NOT NULL THEN v WHEN s.nvs >= 2 AND s.nds > 0 THEN nv + near END AS now,
    CASE WHEN v IS NOT NULL THEN v WHEN s.nvs >= 2 AND s.nds > 0 THEN nv + near END AS prev
  FROM nx n JOIN st s USING (table_id) WHERE n.row_index = 1
  UNION ALL SELECT n.table_id, n.row_index, CASE WHEN v IS NOT NULL THEN v WHEN s.nvs >= 2 AND s.nds > 0 THEN
      CASE WHEN r.prev IS NOT NULL AND nv IS NOT NULL THEN r.prev + round((nv - r.prev) / (np - n.row_index + 1))
        WHEN r.prev IS NOT NULL THEN r.prev - near ELSE nv + near END END,
    coalesce(CASE WHEN v IS NOT NULL THEN v WHEN s.nvs >= 2 AND s.nds > 0 THEN
      CASE WHEN r.prev IS NOT NULL AND nv IS NOT NULL THEN r.prev + round((nv - r.prev) / (np - n.row_index + 1))
        WHEN r.prev IS NOT NULL THEN r.prev - near ELSE nv + near END END, r.prev)
  FROM r JOIN nx n ON n.table_id = r.table_id AND n.row_index = r.row_index + 1 JOIN st s ON s.table_id = n.table_id)"""


@query("filled_stations", "WITH RECURSIVE " + _CELLS + _FILL_NOW + """
SELECT r.table_id, r.row_index, now AS filled_ft, v IS NULL AS was_missing FROM r JOIN cl USING (table_id, row_index)""")
def filled_stations(spark, sf_dir):
    return quality.fill_stations(cells(spark, sf_dir), TABLE, "row_index", "station_ft")


_ARCHIVED = """, dr AS (SELECT *, CASE WHEN nvs >= 2 AND vs[1] > vs[-1] THEN -50.0 ELSE 50.0 END AS d FROM st),
r AS (SELECT n.table_id, n.row_index, CASE WHEN v IS NOT NULL THEN v WHEN nvs >= 1 THEN nv - d END AS now,
    CASE WHEN v IS NOT NULL THEN v WHEN nvs >= 1 THEN nv - d END AS prev FROM nx n JOIN dr s USING (table_id) WHERE n.row_index = 1
  UNION ALL SELECT n.table_id, n.row_index, x.now, coalesce(x.now, r.prev)
  FROM r JOIN nx n ON n.table_id = r.table_id AND n.row_index = r.row_index + 1 JOIN dr s ON s.table_id = n.table_id,
  LATERAL (SELECT round((nv - r.prev) / (np - n.row_index + 1)) AS sh) y,
  LATERAL (SELECT CASE WHEN v IS NOT NULL THEN v WHEN nvs >= 1 THEN CASE WHEN r.prev IS NOT NULL AND nv IS NOT NULL
    THEN r.prev + CASE WHEN abs(sh) < 10 OR abs(sh) > 200 THEN d ELSE sh END WHEN r.prev IS NOT NULL THEN r.prev + d ELSE nv - d END END AS now) x)"""


@query("recognised_row_flow", "WITH RECURSIVE " + _CELLS + _ARCHIVED + """
, j AS (SELECT c.*, r.now AS ft, v IS NULL AS missing FROM r JOIN cl c USING (table_id, row_index) WHERE now IS NOT NULL AND depth_ft IS NOT NULL AND boc_ft IS NOT NULL),
p AS (SELECT *, lead(ft) OVER (PARTITION BY table_id ORDER BY row_index) AS nxt, row_index AS ri FROM j),
s AS (SELECT source_file, least(ft, nxt) AS start_ft, greatest(ft, nxt) AS end_ft, depth_ft, boc_ft, CASE WHEN missing THEN 0.75 ELSE 1.0 END AS confidence
  FROM p WHERE nxt IS NOT NULL AND ft <> nxt)
SELECT source_file, start_ft, end_ft, depth_ft, boc_ft, max(confidence) AS confidence FROM s GROUP BY 1, 2, 3, 4, 5""")
def recognised_row_flow(spark, sf_dir):
    spans = quality.recognised_rows(cells(spark, sf_dir), TABLE, "row_index", "station_ft").where("reject_reason IS NULL")
    keys = ["source_file", "start_ft", "end_ft", "depth_ft", "boc_ft"]
    return stores.best_of_each(spans.select(*keys, "confidence", "table_id"), keys, "confidence", "table_id").drop("table_id")


_RECOGNISED = "WITH RECURSIVE " + _CELLS + _ARCHIVED + """
, j AS (SELECT c.*, r.now AS ft FROM r JOIN cl c USING (table_id, row_index) WHERE now IS NOT NULL AND depth_ft IS NOT NULL AND boc_ft IS NOT NULL),
p AS (SELECT *, lead(ft) OVER (PARTITION BY table_id ORDER BY row_index) AS nxt FROM j),
recognised AS (SELECT source_file, count(*) FILTER (ft <> nxt) AS valid_segments, count(*) FILTER (ft = nxt) AS invalid_rows FROM p WHERE nxt IS NOT NULL GROUP BY 1)"""


@query("recognition_summary", _RECOGNISED + " SELECT * FROM recognised")
def recognition_summary(spark, sf_dir):
    return quality.file_summary(quality.recognised_rows(cells(spark, sf_dir), TABLE, "row_index", "station_ft"), ["source_file"])


@query("recognition_csv", _RECOGNISED + """ SELECT source_file, valid_segments, invalid_rows, valid_segments AS valid_lines, invalid_rows AS invalid_lines FROM recognised""")
def recognition_csv(spark, sf_dir):
    """Counts per file as the summary table says, and as the tables of good and refused spans hold them."""
    spans = quality.recognised_rows(cells(spark, sf_dir), TABLE, "row_index", "station_ft")
    exports.write_recognition(spans, path := new_path(spark, "recognition"))

    def lines(name, as_):
        return exports.read_csv(spark, f"{path}/{name}").groupBy("source_file").agg(F.count("*").alias(as_))

    said = exports.read_csv(spark, f"{path}/{exports.SUMMARY}").select("source_file", F.col("valid_segments").cast("long"), F.col("invalid_rows").cast("long"))
    both = said.join(lines(exports.VALID, "valid_lines"), "source_file", "left").join(lines(exports.INVALID, "invalid_lines"), "source_file", "left")
    return both.fillna(0, ["valid_lines", "invalid_lines"])


_PIECES = ", ".join(f"CASE WHEN length(d) >= {n} THEN CAST({p} AS INT) END" for n in (3, 4, 5) for p in (f"d[1:{n}]", f"d[-{n}:]"))
_STEPS = "[50, 25, 37, 13, 63, 6, 12, 44, 92]"


def _best_sql(options: str) -> str:
    return (f"(list_sort([{{'o': list_min([abs(c - r.prev - s) for s in {_STEPS}]), 'g': c - r.prev}} for c in {options} "
            f"if c > r.prev AND c <= r.prev + 150])[1].g + r.prev)")


@query("repaired_stations", "WITH RECURSIVE " + cte("cells") + f""", a AS (SELECT table_id, row_index,
  regexp_replace(translate(station_raw, '{_SCAN_FROM}', '{_SCAN_TO}'), '[^0-9+]', '', 'g') AS t FROM cells),
b AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d, regexp_replace(split_part(t, '+', 1), '[^0-9]', '', 'g') AS l,
  CASE WHEN contains(t, '+') THEN regexp_replace(substr(t, instr(t, '+') + 1), '[^0-9]', '', 'g') ELSE '' END AS x FROM a),
c AS (SELECT table_id, row_index, list_sort(list_distinct(list_filter([
  CASE WHEN l <> '' AND x <> '' THEN CAST(l AS INT) * 100 + CAST(rpad(x[1:2], 2, '0') AS INT) END,
  CASE WHEN l <> '' AND x <> '' THEN CAST(l AS INT) * 100 + CAST(rpad(x[-2:], 2, '0') AS INT) END, {_PIECES}], lambda v: v IS NOT NULL))) AS cs FROM b),
r AS (SELECT table_id, row_index, list_min(list_filter(cs, lambda v: v <= 40000)) AS now, list_min(list_filter(cs, lambda v: v <= 40000)) AS prev FROM c WHERE row_index = 1
  UNION ALL SELECT c.table_id, c.row_index, y.now, coalesce(y.now, r.prev) FROM r JOIN c ON c.table_id = r.table_id AND c.row_index = r.row_index + 1,
  LATERAL (SELECT flatten([[h * 100 + v % 100 for h in range(greatest(0, r.prev // 100 - 1), r.prev // 100 + 3)] for v in cs]) AS gs) g,
  LATERAL (SELECT CASE WHEN r.prev IS NULL THEN list_min(list_filter(cs, lambda v: v <= 40000))
    ELSE coalesce({_best_sql('cs')}, {_best_sql('gs')}, r.prev + 50) END AS now) y)
SELECT table_id, row_index, CAST(now AS INT) AS station_int FROM r""")
def repaired_stations(spark, sf_dir):
    raw = view(spark, sf_dir, "cells").withColumn("c", st.station_candidates(F.col("station_raw")))
    ints = F.array_sort(F.array_distinct(F.transform("c", lambda s: st.feet_from_station(s).cast("int"))))
    return quality.repair_stations(raw.withColumn("options", ints), TABLE, "row_index", "options")


@query("smoothed_numbers", "WITH " + _CELLS + """, g AS (SELECT *, CASE WHEN depth_ft <> 0 THEN depth_ft END AS d, CASE WHEN boc_ft <> 0 THEN boc_ft END AS b FROM cl),
w AS (SELECT *, last(d IGNORE NULLS) OVER p AS dl, first(d IGNORE NULLS) OVER f AS dr, last(b IGNORE NULLS) OVER p AS bl, first(b IGNORE NULLS) OVER f AS br,
  coalesce(quantile_cont(depth_ft, 0.5) OVER (PARTITION BY table_id), 4.3) AS dm, coalesce(quantile_cont(boc_ft, 0.5) OVER (PARTITION BY table_id), 9.0) AS bm FROM g
  WINDOW p AS (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  f AS (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
x AS (SELECT table_id, row_index, coalesce(d, CASE WHEN dl IS NOT NULL AND dr IS NOT NULL THEN round(round((dl + dr) / 2, 6), 1) END, dl, dr, dm) AS d,
  round(coalesce(b, CASE WHEN bl IS NOT NULL AND br IS NOT NULL THEN round(round((bl + br) / 2, 6)) END, bl, br, bm)) AS b FROM w)
SELECT table_id, row_index, CASE WHEN d > 15 THEN round(d / 10, 1) ELSE d END AS depth_ft,
  CASE WHEN b > 20 THEN CAST(left(CAST(CAST(b AS BIGINT) AS VARCHAR), 1) AS DOUBLE) ELSE b END AS boc_ft FROM x""")
def smoothed_numbers(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return rows.select("table_id", "row_index", quality.smooth_numbers(rows, TABLE, "row_index", "depth_ft", "depth").alias("depth_ft"),
                       quality.smooth_numbers(rows, TABLE, "row_index", "boc_ft", "boc").alias("boc_ft"))


@query("bounded_pair_spans", "WITH " + _CELLS + """, p AS (SELECT *, lead(v) OVER w AS t, lead(row_index) OVER w AS more FROM cl WINDOW w AS (PARTITION BY table_id ORDER BY row_index))
SELECT table_id, row_index, v AS start_ft, t AS end_ft, CASE WHEN v IS NULL OR t IS NULL THEN 'missing station'
  WHEN NOT (t - v BETWEEN 1 AND 150) THEN concat('station jump rejected: ', CAST(t - v AS BIGINT)) END AS reject_reason FROM p WHERE more IS NOT NULL""")
def bounded_pair_spans(spark, sf_dir):
    return quality.pair_spans(cells(spark, sf_dir), TABLE, "row_index", "station_ft", 1, 150).select(
        "table_id", "row_index", "start_ft", "end_ft", "reject_reason")


LOG = ["project_id", "source_file", "print"]
_ROWS = cte("bore_rows") + f", br AS (SELECT *, {feet_sql('station')} AS ft FROM bore_rows)"


def clean_rows(spark, sf_dir):
    return src.clean_bore_rows(view(spark, sf_dir, "bore_rows")).where("reject_reason IS NULL").drop("reject_reason", "station_raw")


@query("deviation_spans", "WITH " + _ROWS + """, n AS (SELECT *, lag(station) OVER w AS ps, lag(ft) OVER w AS pft, lag(depth_ft) OVER w AS pd, lag(boc_ft) OVER w AS pb,
  lead(depth_ft) OVER w AS nd, lead(boc_ft) OVER w AS nb FROM br WINDOW w AS (PARTITION BY project_id, source_file, print ORDER BY ft)),
f AS (SELECT *, round(abs(depth_ft - pd), 6) >= 0.5 AND NOT coalesce(round(abs(nd - depth_ft), 6) >= 0.5 AND round(abs(nd - pd), 6) < 0.5, false) AS dh,
  round(abs(boc_ft - pb), 6) >= 1.0 AND NOT coalesce(round(abs(nb - boc_ft), 6) >= 1.0 AND round(abs(nb - pb), 6) < 1.0, false) AS bh,
  contains(notes, 'rock') AS nh FROM n WHERE pft IS NOT NULL),
h AS (SELECT *, dh OR bh OR nh AS hit, coalesce(lag(dh OR bh OR nh) OVER w, false) AS was FROM f WINDOW w AS (PARTITION BY project_id, source_file, print ORDER BY ft)),
i AS (SELECT *, max(CASE WHEN hit AND NOT was THEN ft END) OVER (PARTITION BY project_id, source_file, print ORDER BY ft) AS run FROM h),
g AS (SELECT project_id, source_file, print, run, arg_min(ps, ft) AS ss, min(pft) AS s, arg_max(station, ft) AS es, max(ft) AS e, arg_min(depth_ft, ft) AS depth_ft, arg_min(boc_ft, ft) AS boc_ft,
  count(*) FILTER (hit AND (dh OR bh)) AS np, count(*) FILTER (hit AND nh) AS nn, bool_or(hit AND dh) AS dh, bool_or(hit AND bh) AS bh FROM i WHERE hit OR was GROUP BY ALL),
k AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM g WHERE nn > 0 OR np >= 2 WINDOW w AS (PARTITION BY project_id, source_file, print ORDER BY run)),
m AS (SELECT *, sum(new) OVER (PARTITION BY project_id, source_file, print ORDER BY run) AS part FROM k),
z AS (SELECT project_id, source_file, print, part, arg_min(ss, run) AS start_station, arg_max(es, run) AS end_station, min(s) AS start_ft, max(e) AS end_ft, arg_min(depth_ft, run) AS depth_ft,
  arg_min(boc_ft, run) AS boc_ft, CAST(sum(np) AS BIGINT) AS numeric_points, CAST(sum(nn) AS BIGINT) AS note_points, bool_or(dh) AS dh, bool_or(bh) AS bh FROM m GROUP BY ALL)
SELECT project_id, source_file, print, start_station, end_station, start_ft, end_ft, depth_ft, boc_ft, numeric_points, note_points,
  CASE WHEN note_points > 0 THEN 'hard rock' ELSE '' END AS notes,
  concat_ws('; ', CASE WHEN dh AND bh THEN 'Depth + BOC shift' WHEN dh THEN 'Depth deviation' WHEN bh THEN 'BOC shift' END, CASE WHEN note_points > 0 THEN 'Field notes' END) AS reason
FROM z WHERE end_ft - start_ft >= 50""")
def deviation_spans(spark, sf_dir):
    return quality.deviation_spans(clean_rows(spark, sf_dir), LOG)


@query("deviation_events", "WITH " + _ROWS + """SELECT project_id, source_file, min(ft) AS start_ft, max(ft) AS end_ft, round(max(boc_ft), 2) AS max_offset_ft,
  round(avg(boc_ft), 2) AS avg_offset_ft, round(max(abs(depth_ft - 3.8)), 2) AS max_depth_delta_ft FROM br GROUP BY 1, 2""")
def deviation_events(spark, sf_dir):
    rows = clean_rows(spark, sf_dir).withColumns({"offset_ft": F.col("boc_ft"), "depth_delta_ft": F.col("depth_ft") - 3.8})
    return quality.event_rollup(rows, ["project_id", "source_file"])


_FLAGS = "WITH " + _ROWS + """, n AS (SELECT *, lag(ft) OVER w AS pft, lag(depth_ft) OVER w AS pd, lag(boc_ft) OVER w AS pb, row_number() OVER w AS rn FROM br
  WINDOW w AS (PARTITION BY project_id, source_file, print ORDER BY ft)),
t AS (SELECT *, coalesce(depth_ft < 3.5, false) AS a, coalesce(round(abs(depth_ft - pd), 6) >= 1.5, false) AS b, coalesce(ft - pft > 100, false) AS c, coalesce(round(abs(boc_ft - pb), 6) >= 4, false) AS d, coalesce(boc_ft > 25, false) AS e FROM n),
flagged AS (SELECT project_id, source_file, print, station, concat_ws(',', CASE WHEN a THEN 'SHALLOW_DEPTH' END, CASE WHEN b THEN 'DEPTH_JUMP' END, CASE WHEN c THEN 'STATION_GAP' END, CASE WHEN d THEN 'BOC_JUMP' END,
  CASE WHEN e THEN 'OFF_ROUTE' END, CASE WHEN a AND (b OR d) THEN 'HIGH_RISK' END) AS flags,
  concat_ws(',', CASE WHEN a THEN 'Shallow Depth' END, CASE WHEN b THEN 'Depth Change' END, CASE WHEN c THEN 'Station Gap' END, CASE WHEN d THEN 'Rod Change' END,
  CASE WHEN e THEN 'Off Route' END, CASE WHEN a AND (b OR d) THEN 'High Risk' END) AS labels,
  CASE WHEN a AND (b OR d) THEN 'red' WHEN a OR b OR c OR d THEN 'orange' WHEN e THEN 'yellow' ELSE 'green' END AS colour FROM t)"""


@query("point_flags", _FLAGS + " SELECT * FROM flagged")
def point_flags(spark, sf_dir):
    rows = clean_rows(spark, sf_dir).withColumns({"offset_ft": F.col("boc_ft"), "wrong_street": F.lit(False), "row_no": F.col("station_ft")})
    return quality.point_flags(rows, LOG).select(
        *LOG, "station", F.array_join("flags", ",").alias("flags"), F.array_join("labels", ",").alias("labels"), "colour")


@query("qa_point_features", _FLAGS + """ SELECT project_id, 'Feature' AS feature_type, 'Point' AS geometry_type, station, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n_flags,
  colour AS qa_color, '[-96.4,30.16]' AS coordinates, count(*) AS n FROM flagged GROUP BY ALL""")
def qa_point_features(spark, sf_dir):
    """Judged rows as map features, written as text and read again."""
    rows = clean_rows(spark, sf_dir).withColumns({"offset_ft": F.col("boc_ft"), "wrong_street": F.lit(False), "row_no": F.col("station_ft")})
    judged = quality.point_flags(rows, LOG).withColumns({"display_flags": F.col("labels"), "qa_color": F.col("colour"), "lat": F.lit(30.16), "lon": F.lit(-96.4)})
    features = exports.point_features(judged, ["station", "depth_ft", "flags", "display_flags", "qa_color"])
    exports.write_features(features, path := new_path(spark, "features"))
    text = spark.read.text(path)

    def part(path_: str):
        return F.get_json_object("value", path_)

    return text.groupBy("project_id", part("$.type").alias("feature_type"), part("$.geometry.type").alias("geometry_type"), part("$.properties.station").alias("station"),
                        F.json_array_length(part("$.properties.flags")).alias("n_flags"), part("$.properties.qa_color").alias("qa_color"),
                        part("$.geometry.coordinates").alias("coordinates")).agg(F.count("*").alias("n"))


@query("wrong_street", sql(*RAW, cte("gps_fixes"), then="""
, s AS (SELECT f.event_id, f.accuracy_m * 4 AS off, event_id % 360 AS heading, seg.*, f.lat AS plat, f.lon AS plon, 364000.0 * cos(radians((a_lat + b_lat) / 2)) AS e FROM gps_fixes f JOIN seg USING (project_id, route_id)),
t AS (SELECT *, least(greatest(((plon - a_lon) * (b_lon - a_lon) * e * e + (plat - a_lat) * (b_lat - a_lat) * 364000.0 * 364000.0) / (pow((b_lon - a_lon) * e, 2) + pow((b_lat - a_lat) * 364000.0, 2)), 0), 1) AS k FROM s),
u AS (SELECT *, sqrt(pow((plon - a_lon - (b_lon - a_lon) * k) * e, 2) + pow((plat - a_lat - (b_lat - a_lat) * k) * 364000.0, 2)) AS d,
 (degrees(atan2(sin(radians(b_lon - a_lon)) * cos(radians(b_lat)), cos(radians(a_lat)) * sin(radians(b_lat)) - sin(radians(a_lat)) * cos(radians(b_lat)) * cos(radians(b_lon - a_lon)))) + 360.0) % 360.0 AS street FROM t),
n AS (SELECT event_id, heading, any_value(off) AS off, arg_min(street, (round(d, 6), seg_idx)) AS street FROM u GROUP BY 1, 2)
SELECT event_id, off > 40 AND abs((heading - street + 180 + 360) % 360 - 180) > 35 AS wrong_street FROM n"""))
def wrong_street(spark, sf_dir):
    from trenchline.functions import geo

    segs = routes.route_segments(raw_chain(spark, sf_dir))
    fixes = view(spark, sf_dir, "gps_fixes").select(
        "event_id", *routes.KEY, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), (F.col("accuracy_m") * 4).alias("off"))
    near = routes.nearest_on_route(fixes, segs, ["event_id", *routes.KEY]).join(fixes.select("event_id", "off"), "event_id")
    street = segs.select(*routes.KEY, "seg_idx", geo.bearing_deg(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("street"))
    return near.join(street, [*routes.KEY, "seg_idx"]).select(
        "event_id", quality.wrong_street(F.col("off"), F.col("event_id") % 360, F.col("street")).alias("wrong_street"))


@query("extracted_station_rows", with_views("cells", then=f"""
SELECT source_file, {scan_sql('station_raw')} AS station, {feet_sql(scan_sql('station_raw'))} AS station_ft, {number_sql('depth_raw')} AS depth_ft, {number_sql('boc_raw')} AS boc_ft, trim(notes) AS notes
FROM cells WHERE {scan_sql('station_raw')} IS NOT NULL"""))
def extracted_station_rows(spark, sf_dir):
    raw = view(spark, sf_dir, "cells").select(
        "source_file", F.when(F.col("row_index") % 2 == 0, F.col("station_raw")).otherwise(" ").alias("station"), F.col("station_raw").alias("start_station"),
        F.col("depth_raw").alias("depth_ft"), F.col("boc_raw").alias("boc_ft"), "notes")
    return quality.extracted_station_rows(raw)


@query("bore_ranges", "WITH " + _ROWS + """SELECT project_id, source_file, min(ft) AS start_ft, max(ft) AS end_ft,
  printf('%02d+%02d', CAST(min(ft) AS BIGINT) // 100, CAST(min(ft) AS BIGINT) % 100) AS start_label,
  printf('%02d+%02d', CAST(max(ft) AS BIGINT) // 100, CAST(max(ft) AS BIGINT) % 100) AS end_label, 'ok' AS status FROM br GROUP BY 1, 2""")
def bore_ranges(spark, sf_dir):
    return quality.bore_ranges(clean_rows(spark, sf_dir), ["project_id", "source_file"])


@query("non_empty_rows", with_views("cells", then="""
SELECT table_id, row_index, CASE WHEN station_raw <> '' THEN station_raw END AS station_raw, CASE WHEN depth_raw <> '' THEN depth_raw END AS depth_raw
FROM cells WHERE station_raw <> '' OR depth_raw <> ''"""))
def non_empty_rows(spark, sf_dir):
    raw = view(spark, sf_dir, "cells").select(
        "table_id", "row_index", F.nullif("station_raw", F.lit("")).alias("station_raw"), F.nullif("depth_raw", F.lit("")).alias("depth_raw"),
        F.lit(None).cast("string").alias("blank"))
    return src.drop_empty(raw, ["table_id", "row_index"])
