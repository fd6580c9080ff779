"""Queries from log rows to groups, candidate routes and anchored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.operators import candidates as cand
from trenchline.operators import quality, routes, windows
from trenchline.plans.check_sql import RAW, ROUTES, hav, sql
from trenchline.plans.inputs import cte, view
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_geometry import r, raw_chain
from trenchline.plans.queries_quality import clean_rows
from trenchline.plans.queries_text import feet_sql
from trenchline.plans.registry import query

GID = ["project_id", "source_file", "tokens_key", "min_station_ft"]

_GROUPS = [
    cte("bore_rows"), cte("sheet_index"),
    f"""kr AS (SELECT *, {feet_sql('station')} AS ft, array_to_string(list_sort(list_transform(string_split(replace(print, ';', ','), ','), lambda t: trim(t))), ',') AS tokens_key FROM bore_rows)""",
    "kn AS (SELECT *, row_number() OVER (PARTITION BY project_id, source_file, tokens_key ORDER BY ft, date, crew) AS n FROM kr)",
    """fold AS (SELECT project_id, source_file, tokens_key, n, ft, crew, CAST([] AS DOUBLE[]) AS steps, 0 AS gid FROM kn WHERE n = 1
  UNION ALL SELECT k.project_id, k.source_file, k.tokens_key, k.n, k.ft, k.crew, CASE WHEN b THEN [] ELSE list_append(steps, k.ft - f.ft) END, gid + CAST(b AS INT)
  FROM fold f JOIN kn k ON k.project_id = f.project_id AND k.source_file = f.source_file AND k.tokens_key = f.tokens_key AND k.n = f.n + 1,
  LATERAL (SELECT k.ft - f.ft <= 0 OR (k.crew <> '' AND f.crew <> '' AND k.crew <> f.crew)
    OR k.ft - f.ft > greatest(150.0, 3.5 * coalesce(list_median(steps), 50.0)) AS b) x)""",
    """grp AS (SELECT f.project_id, f.source_file, f.tokens_key, gid, min(f.ft) AS mn, max(f.ft) AS mx, max(f.ft) - min(f.ft) AS span, count(*) AS n,
  arg_min(print, f.ft) AS first_print, list(f.ft ORDER BY f.ft) AS fts FROM fold f JOIN kn USING (project_id, source_file, tokens_key, n) GROUP BY 1, 2, 3, 4)""",
    """gtok AS (SELECT project_id, source_file, tokens_key, gid, unnest(string_split(tokens_key, ',')) AS token FROM grp)""",
    """hint AS (SELECT project_id, source_file, tokens_key, gid, list_sort(list_distinct(list(sheet))) AS sheets, list_sort(list_distinct(list(street))) AS streets,
  list_sort(list_distinct(list(route_id))) AS allowed FROM gtok JOIN sheet_index USING (project_id, token) GROUP BY 1, 2, 3, 4)""",
    """gh AS (SELECT g.*, coalesce(sheets, []) AS sheets, coalesce(streets, []) AS streets, coalesce(allowed, []) AS allowed FROM grp g LEFT JOIN hint USING (project_id, source_file, tokens_key, gid))""",
]

_POOL = [
    """pool0 AS (SELECT g.*, c.route_id, route_name, source_folder, route_role, length_ft, total_ft, point_count, list_contains(allowed, c.route_id) AS named,
  max(CAST(list_contains(allowed, c.route_id) AS INT)) OVER (PARTITION BY g.project_id, g.source_file, g.tokens_key, gid) AS any_named FROM gh g JOIN catalog_ c USING (project_id))""",
    """pool1 AS (SELECT *, span <= 0 OR length_ft >= span * 0.7 AS fits FROM pool0 WHERE any_named = 0 OR named)""",
    """pool2 AS (SELECT *, max(CAST(fits AS INT)) OVER (PARTITION BY project_id, source_file, tokens_key, gid) AS any_fit FROM pool1)""",
    """pool AS (SELECT *, any_named = 1 AS print_filtered, CASE WHEN any_fit = 1 AND contains(lower(source_folder), split_part(source_file, '_', 1)) THEN 0.03 ELSE 0 END AS name_hint,
  CASE WHEN span > 0 THEN least(span, length_ft) / greatest(span, length_ft) ELSE 0 END AS ratio, abs(length_ft - span) AS gap,
  CASE WHEN span > 0 AND length_ft > span THEN length_ft / greatest(span, 1) ELSE 0 END AS over,
  list_position(CASE WHEN span <= 160 THEN ['house_drop', 'vacant_pipe', 'terminal_tail'] WHEN span <= 1200 THEN ['terminal_tail', 'underground_cable', 'vacant_pipe']
    ELSE ['underground_cable', 'backbone', 'terminal_tail'] END, route_role) AS place FROM pool2 WHERE fits OR any_fit = 0)""",
    """fam AS (SELECT *, count(*) OVER f AS fs, min(gap) OVER f AS bg, min(length_ft) OVER f AS sl, max(length_ft) OVER f AS ll,
  round(least(1, CASE WHEN span > 0 THEN greatest(0, pow(ratio, 2.35) - least(0.42, greatest(0, (over - 1) * 0.18))) ELSE 0 END
    + CASE place WHEN 1 THEN 0.18 WHEN 2 THEN 0.10 WHEN 3 THEN 0.04 ELSE 0 END + CASE WHEN point_count >= 3 THEN 0.02 ELSE 0 END), 6) AS base_score FROM pool
  WINDOW f AS (PARTITION BY project_id, source_file, tokens_key, gid, lower(route_name), route_role))""",
    """scored AS (SELECT *, round(CASE WHEN len(allowed) = 1 AND list_contains(allowed, route_id) THEN 0.14 ELSE 0 END
   + CASE WHEN fs > 1 THEN greatest(0, 1 - (gap - bg) / greatest(60, span * 0.2)) * 0.1 ELSE 0 END
   + CASE WHEN fs > 1 AND ll > sl AND span > 0 THEN ratio * 0.04 ELSE 0 END, 6) AS family_bonus FROM fam)""",
    """scores AS (SELECT *, round(least(1, greatest(0, base_score + CASE WHEN print_filtered THEN 0.1 ELSE 0 END + ratio * 0.08
   + CASE WHEN span > 0 THEN greatest(0, 1 - gap / greatest(span, 1)) * 0.16 ELSE 0 END + CASE WHEN route_role IN ('underground_cable', 'backbone', 'terminal_tail') THEN 0.04 ELSE 0 END
   + name_hint + family_bonus - least(0.3, greatest(0, (over - 1.15) * 0.1)))), 6) AS score FROM scored)""",
    """ranked AS (SELECT *, lead(score) OVER w AS next_score FROM (SELECT *, row_number() OVER w AS rank FROM scores
   WINDOW w AS (PARTITION BY project_id, source_file, tokens_key, gid ORDER BY score DESC, round(gap, 2), length_ft, route_name, route_id)) WHERE rank <= 8
   WINDOW w AS (PARTITION BY project_id, source_file, tokens_key, gid ORDER BY rank))""",
]

_K = "project_id, source_file, tokens_key, gid, route_id"
_WINDOWS = [
    "rsheets AS (SELECT project_id, route_id, list_sort(list_distinct(list(sheet))) AS rs FROM sheet_index GROUP BY 1, 2)",
    """hyp AS (SELECT r.*, greatest(1, span) AS s, CASE WHEN (len(allowed) = 0 OR list_contains(allowed, r.route_id)) AND len(sheets) > 0 AND rs IS NOT NULL THEN
  CASE WHEN len(rs) = 1 THEN [0.5::DOUBLE] ELSE [(list_sort([{'d': abs(rs[i] - x), 'i': i} for i in range(1, len(rs) + 1)])[1].i - 1) / (len(rs) - 1) for x in sheets] END ELSE CAST([] AS DOUBLE[]) END AS fr
  FROM ranked r LEFT JOIN rsheets USING (project_id, route_id) WHERE rank <= 3)""",
    f"""gen AS (SELECT {_K}, 0.0::DOUBLE AS a, total_ft AS b, 'full_route_window' AS t, -1 AS o FROM hyp WHERE total_ft <= s
  UNION ALL SELECT {_K}, k * st, k * st + s, 'coarse_window', 0 FROM (SELECT *, greatest(10, least(40, s / 8)) AS st, unnest(range(0, CAST(floor((total_ft - s + 1e-6) / greatest(10, least(40, s / 8))) AS BIGINT) + 1)) AS k FROM hyp WHERE total_ft > s)
  UNION ALL SELECT {_K}, k * st, k * st + s, 'fine_window', 1 FROM (SELECT *, greatest(5, least(20, s / 16)) AS st, unnest(range(0, CAST(floor((total_ft - s + 1e-6) / greatest(5, least(20, s / 16))) AS BIGINT) + 1)) AS k FROM hyp WHERE total_ft > s)
  UNION ALL SELECT {_K}, 0, s, 'origin_window', 2 FROM hyp WHERE total_ft > s
  UNION ALL SELECT {_K}, total_ft - s, total_ft, 'tail_window', 3 FROM hyp WHERE total_ft > s
  UNION ALL SELECT {_K}, (total_ft - s) / 2, (total_ft - s) / 2 + s, 'mid_window', 4 FROM hyp WHERE total_ft > s
  UNION ALL SELECT {_K}, chain, chain + s, 'vertex_forward', 5 FROM hyp JOIN dch USING (project_id, route_id) WHERE total_ft > s
  UNION ALL SELECT {_K}, chain - s, chain, 'vertex_backward', 6 FROM hyp JOIN dch USING (project_id, route_id) WHERE total_ft > s)""",
    f"""win AS (SELECT DISTINCT {_K}, round(greatest(0, least(a, total_ft)), 2) AS ws,
    CASE WHEN o < 0 THEN total_ft ELSE round(greatest(greatest(0, least(a, total_ft)), least(b, total_ft)), 2) END AS we, t, o
  FROM gen JOIN hyp USING ({_K}))""",
    f"""hits AS (SELECT {_K}, ws, count(DISTINCT v.chunk_base + least(n_chunks - 1, CAST(floor((d - start_ft) / (end_ft - start_ft) * n_chunks) AS INT))) AS nv FROM
  (SELECT {_K}, ws, greatest(1e-12, least(ws + unnest(fts) - mn, total_ft)) AS d FROM (SELECT DISTINCT {_K}, ws FROM win) JOIN hyp USING ({_K})) p
  ASOF JOIN dseg v ON v.project_id = p.project_id AND v.route_id = p.route_id AND p.d > v.start_ft GROUP BY ALL)""".replace(
        "hits AS (SELECT project_id, source_file, tokens_key, gid, route_id, ws,", "hits AS (SELECT p.project_id, source_file, tokens_key, gid, p.route_id, ws,"),
    "npc AS (SELECT project_id, route_id, sum(n_chunks) AS np FROM dseg GROUP BY 1, 2)",
    f"""wsc AS (SELECT w.*, span, total_ft, length_ft, route_role, rank, route_name, score, np, nv, fts, mn, fr, n AS n_rows,
   round(least(1, greatest(0, greatest(0, 1 - abs(greatest(0, we - ws) - s) / s) * 0.6 + least(1, nv / greatest(1, np)) * 0.2 + least(1, least(ws, greatest(0, total_ft - we)) / s) * 0.12
     + CASE WHEN point_count >= 4 THEN 0.08 ELSE 0 END)), 6) AS wbase,
   CASE WHEN len(fr) = 0 THEN 0 ELSE round(greatest(0, 1 - list_min([abs(greatest(0, least((ws + we) / 2, total_ft)) / greatest(total_ft, 1) - f) for f in fr]) / 0.18) * 0.12, 6) END AS bias
   FROM win w JOIN hyp USING ({_K}) JOIN hits USING ({_K}, ws) JOIN npc USING (project_id, route_id))""",
    f"""wbest AS (SELECT *, round(round(least(1, score + wscore * 0.35), 9), 6) AS combined FROM (SELECT *, round(least(1, greatest(0, wbase + bias)), 6) AS wscore, count(*) OVER (PARTITION BY {_K}) AS n_windows FROM wsc)
   QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY wscore DESC, bias DESC, abs(abs(we - ws) - span), ws, o) = 1)""",
    """anch AS (SELECT *, row_number() OVER (PARTITION BY project_id, source_file, tokens_key, gid ORDER BY combined DESC, score DESC, route_name, route_id) AS anchor_rank FROM wbest)""",
]

RECURSIVE = "RECURSIVE "
_GID_SQL = "project_id, source_file, tokens_key, mn AS min_station_ft"


def match_sql(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then


GROUP_CTES, POOL_CTES, WINDOW_CTES = _GROUPS, _POOL, _WINDOWS
GROUP_FOLD = [c for c in _GROUPS if c.startswith(("bore_rows ", "kr ", "kn ", "fold "))]


@query("bore_groups", match_sql(*_GROUPS, then=f"""SELECT {_GID_SQL}, mx AS max_station_ft, span AS span_ft, n AS row_count, first_print,
  len(sheets) AS n_sheets, len(allowed) AS n_allowed, CAST(coalesce(list_min(sheets), list_min([CAST(t AS INT) for t in string_split(tokens_key, ',')])) AS INT) AS print_order,
  concat('sheet::', coalesce(list_min(sheets), list_min([CAST(t AS INT) for t in string_split(tokens_key, ',')]))) AS anchor_key, 0 AS duplicate_stations FROM gh"""))
def bore_groups(spark, sf_dir):
    return Job.of(spark, sf_dir).groups.select(
        *GID, "max_station_ft", "span_ft", "row_count", "first_print", F.size("sheets").alias("n_sheets"),
        F.size("allowed_routes").alias("n_allowed"), "print_order", "anchor_key", "duplicate_stations")


@query("candidate_routes", match_sql(*_GROUPS, *ROUTES, *_POOL, then=f"""SELECT {_GID_SQL}, route_id, rank, score, base_score, family_bonus, round(gap, 2) AS length_gap_ft, print_filtered,
  CASE WHEN (score >= 0.9 AND round(score - coalesce(next_score, 0), 6) >= 0.14) OR (score >= 0.78 AND round(score - coalesce(next_score, 0), 6) >= 0.07) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ranked"""))
def candidate_routes(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    keys = job.groups.select("project_id", "group_id", "tokens_key", "min_station_ft")
    return job.ranked.join(keys, ["project_id", "group_id"]).select(
        *GID, "route_id", "rank", "score", "base_score", "family_bonus", "length_gap_ft", "print_filtered",
        cand.ranking_confidence(F.col("score"), F.col("next_score")).alias("confidence"))


def anchored(spark, sf_dir):
    return Job.of(spark, sf_dir).anchored


@query("anchored_windows", match_sql(*_GROUPS, *ROUTES, *_POOL, *_WINDOWS, then=f"""SELECT {_GID_SQL}, route_id, ws AS start_ft, round(we, 2) AS end_ft, t AS window_type, wscore AS window_score,
  bias, n_windows, combined, anchor_rank FROM anch"""))
def anchored_windows(spark, sf_dir):
    return anchored(spark, sf_dir).select(*GID, "route_id", "start_ft", "end_ft", "window_type", "window_score", "bias", "n_windows", "combined", "anchor_rank")


@query("projected_points", match_sql(*_GROUPS, *ROUTES, *_POOL, *_WINDOWS, then=f"""
, pp AS (SELECT a.*, unnest(range(0, len(fts))) AS pos, ws + unnest(fts) - mn AS rf FROM anch a),
pd AS (SELECT *, greatest(1e-12, least(rf, total_ft)) AS d FROM pp)
SELECT p.project_id, source_file, tokens_key, mn AS min_station_ft, p.route_id, pos, round(rf, 2) AS route_ft, round(round(a_lat + (b_lat - a_lat) * (d - start_ft) / (end_ft - start_ft), 8), 6) AS lat,
  round(round(a_lon + (b_lon - a_lon) * (d - start_ft) / (end_ft - start_ft), 8), 6) AS lon, seg_idx,
  CAST(chunk_base + least(n_chunks - 1, CAST(floor((d - start_ft) / (end_ft - start_ft) * n_chunks) AS INT)) AS INT) AS piece
FROM pd p ASOF JOIN dseg v ON v.project_id = p.project_id AND v.route_id = p.route_id AND p.d > v.start_ft"""))
def projected_points(spark, sf_dir):
    zipped = F.posexplode(F.arrays_zip("p_route_ft", "p_lat", "p_lon", "p_seg", "p_piece")).alias("pos", "p")
    return anchored(spark, sf_dir).select(*GID, "route_id", zipped).select(
        *GID, "route_id", "pos", F.col("p.p_route_ft").alias("route_ft"), F.round("p.p_lat", 6).alias("lat"), F.round("p.p_lon", 6).alias("lon"),
        F.col("p.p_seg").alias("seg_idx"), F.col("p.p_piece").alias("piece"))


_LOGS = f"""lg AS (SELECT project_id, source_file, min({feet_sql('station')}) AS start_ft, max({feet_sql('station')}) AS end_ft FROM bore_rows GROUP BY 1, 2)"""
_SIMPLE = f"""sr AS (SELECT project_id, route_id, CAST(floor(sum(step) / 0.3048 + 1e-9) AS INT) AS end_station FROM
  (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', metres=True)} AS step FROM vertices WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)) GROUP BY 1, 2)"""
_SIMPLE_MATCH = """sm AS (SELECT l.*, route_id, end_station, greatest(0, least(end_ft, end_station) - greatest(start_ft, 0)) / (end_ft - start_ft) * 60
  + greatest(0, 30 - abs(end_station - (end_ft - start_ft)) / end_station * 30) + 10 AS score FROM lg l JOIN sr USING (project_id)),
sb AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY project_id, source_file ORDER BY round(score, 6) DESC, route_id) = 1)"""


def simple_pairs(spark, sf_dir):
    logs = quality.bore_ranges(clean_rows(spark, sf_dir), ["project_id", "source_file"]).select("project_id", "source_file", "start_ft", "end_ft")
    names = view(spark, sf_dir, "route_meta").select("project_id", "route_id", "route_name")
    plain = routes.simple_routes(view(spark, sf_dir, "vertices")).join(names, routes.KEY)
    return cand.simple_match(logs, plain)


@query("simple_matches", sql(cte("bore_rows"), cte("vertices"), _LOGS, _SIMPLE, _SIMPLE_MATCH, then="""
SELECT project_id, source_file, start_ft, end_ft, route_id, round(score, 4) AS score, end_station, CASE WHEN score < 40 THEN 'rejected' ELSE 'matched' END AS status FROM sb"""))
def simple_matches(spark, sf_dir):
    return simple_pairs(spark, sf_dir).withColumn("score", F.round("score", 4))


@query("simple_redlines", sql(*RAW, cte("bore_rows"), _LOGS, _SIMPLE, _SIMPLE_MATCH, then="""
, c AS (SELECT *, least(start_ft, end_station) AS f, least(end_ft, end_station) AS t FROM sb WHERE score >= 40)
SELECT c.project_id, c.source_file, c.route_id, f AS from_ft, t AS to_ft, printf('%02d+%02d', CAST(f AS BIGINT) // 100, CAST(f AS BIGINT) % 100) AS start_label,
  printf('%02d+%02d', CAST(t AS BIGINT) // 100, CAST(t AS BIGINT) % 100) AS end_label, t - f AS length_ft, count(*) + 1 AS n_points
FROM c JOIN seg s ON s.project_id = c.project_id AND s.route_id = c.route_id AND s.end_ft >= f AND s.start_ft <= t GROUP BY ALL"""))
def simple_redlines(spark, sf_dir):
    cut = cand.simple_redline(simple_pairs(spark, sf_dir), routes.as_polylines(raw_chain(spark, sf_dir)))
    return cut.withColumn("n_points", F.size("coords")).drop("coords")


_FIT = """lf AS (SELECT l.project_id, source_file, c.route_id, c.route_name, route_role, length_ft, end_ft - start_ft AS span, end_ft AS far, length_ft / greatest(end_ft - start_ft, 1) AS fit,
  c.route_id = concat('route_', split_part(source_file, '_', 3)) AS sug FROM lg l JOIN catalog_ c USING (project_id)),
lc AS (SELECT *, length_ft >= far - 1e-6 AS cov, 1 - least(1, abs(1 - fit)) AS c0 FROM lf),
ld AS (SELECT *, round(CASE WHEN sug THEN least(1, c1 + 0.05) ELSE c1 END, 4) AS conf, round(fit, 4) AS f4 FROM (SELECT *, CASE WHEN cov THEN least(1, c0 + 0.15) ELSE greatest(0.05, c0 - 0.35) END AS c1 FROM lc)),
le AS (SELECT *, CASE WHEN conf >= 0.8 AND cov AND f4 BETWEEN 0.75 AND 1.08 THEN 'Strong match' WHEN conf >= 0.55 AND cov AND f4 BETWEEN 0.55 AND 1.25 THEN 'Possible match'
  WHEN NOT cov THEN 'Low confidence' ELSE 'Review needed' END AS lab, max(conf) OVER p AS top, first(route_id) OVER (PARTITION BY project_id, source_file ORDER BY conf DESC, route_id) AS top_route FROM ld
  WINDOW p AS (PARTITION BY project_id, source_file))"""


def fitted(spark, sf_dir):
    logs = quality.bore_ranges(clean_rows(spark, sf_dir), ["project_id", "source_file"])
    job = Job.of(spark, sf_dir)
    pairs = logs.join(job.catalog.drop("coords", "chain"), "project_id").withColumns({
        "span_ft": F.col("end_ft") - F.col("start_ft"), "farthest_ft": F.col("end_ft"),
        "suggested": F.col("route_id") == F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1))})
    return cand.length_fit(pairs)


@query("length_fit_matches", sql(*ROUTES, cte("bore_rows"), _LOGS, _FIT, then="""
SELECT project_id, source_file, route_id, f4 AS length_fit, conf AS confidence, cov AS covers, lab AS confidence_label, round(round(abs(length_ft - span), 6), 1) AS length_delta_ft FROM le"""))
def length_fit_matches(spark, sf_dir):
    return fitted(spark, sf_dir).select("project_id", "source_file", "route_id", "length_fit", "confidence", "covers", "confidence_label", "length_delta_ft")


@query("route_recommendations", sql(*ROUTES, cte("bore_rows"), _LOGS, _FIT, then="""
SELECT project_id, source_file, route_id, CASE WHEN route_id = top_route AND conf >= 0.9 AND cov THEN 'Recommended' WHEN conf >= greatest(0.75, round(top - 0.08, 6)) THEN 'Alternative'
  WHEN conf >= 0.55 THEN 'Review option' ELSE 'Low-confidence option' END AS label,
  concat_ws('; ', CASE WHEN cov THEN 'covers the farthest station' ELSE 'shorter than the farthest station' END,
   CASE WHEN round(round(abs(length_ft - span), 6), 1) <= 50 THEN 'very tight length' WHEN round(round(abs(length_ft - span), 6), 1) <= 150 THEN 'good length' ELSE 'weak length' END,
   CASE WHEN route_role IN ('underground_cable', 'backbone', 'vacant_pipe', 'terminal_tail') THEN 'drill-path role' ELSE 'other role' END, 'many extra turns') AS reasons FROM le"""))
def route_recommendations(spark, sf_dir):
    penalty = routes.turn_penalty(raw_chain(spark, sf_dir)).select(*routes.KEY, "penalty")
    found = cand.recommend(fitted(spark, sf_dir).join(penalty, routes.KEY), ["project_id", "source_file"])
    return found.select("project_id", "source_file", "route_id", "label", F.array_join("reasons", "; ").alias("reasons"))


@query("file_assignments", sql(*ROUTES, cte("bore_rows"), _LOGS, _FIT, then="""
SELECT project_id, source_file, CASE WHEN source_file LIKE 'zone0%' THEN concat('route_', split_part(source_file, '_', 3)) END AS route_id,
  CASE WHEN source_file LIKE 'zone0%' THEN route_name END AS route_name, CASE WHEN source_file LIKE 'zone0%' THEN lab END AS match_label FROM le WHERE sug"""))
def file_assignments(spark, sf_dir):
    fits = fitted(spark, sf_dir)
    logs = fits.select("project_id", "source_file").distinct()
    choices = logs.where(F.startswith("source_file", F.lit("zone0"))).select(
        "project_id", "source_file", F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1)).alias("route_id"), F.lit("").alias("route_name"))
    return cand.file_assignments(logs, choices, Job.of(spark, sf_dir).catalog, fits)


@query("file_runs", sql(*RAW, cte("bore_rows"), then=f"""
, p AS (SELECT DISTINCT project_id, source_file, concat('route_', split_part(source_file, '_', 3)) AS route_id, {feet_sql('station')} AS ft FROM bore_rows),
m AS (SELECT *, ft - min(ft) OVER (PARTITION BY project_id, source_file) AS rel_ft FROM p),
g AS (SELECT project_id, source_file, route_id, count(*) AS n_points, max(rel_ft) AS to_ft, 0.0 AS from_ft FROM m GROUP BY 1, 2, 3)
SELECT project_id, source_file, route_id, n_points, from_ft, to_ft, n_points >= 2 AND to_ft >= 1 AS usable FROM g"""))
def file_runs(spark, sf_dir):
    rows = quality.relative_progress(clean_rows(spark, sf_dir), ["project_id", "source_file"]).withColumn(
        "route_id", F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1)))
    once = rows.dropDuplicates(["project_id", "source_file", "station"])
    located = routes.locate(once, routes.route_segments(raw_chain(spark, sf_dir)))
    return cand.file_runs(located).select("project_id", "source_file", "route_id", "n_points", F.col("a.at_ft").alias("from_ft"), F.col("z.at_ft").alias("to_ft"), "usable")


@query("projected_anchors")
def projected_anchors(spark, sf_dir):
    from trenchline.operators.anchors import search_anchors

    return search_anchors(Job.of(spark, sf_dir).hypothesis_inputs).select(
        *GID, "route_id", "anchor_start_ft", "anchor_end_ft", "anchor_fit", "subsection_score", "anchor_combined", "anchor_method", "n_starts")


@query("absolute_anchors", match_sql(*_GROUPS, then=f"""SELECT {_GID_SQL}, 0.0 AS anchor_offset_ft, CASE WHEN span > 0 THEN 0.0 ELSE mn END AS anchored_start_ft, CASE WHEN span > 0 THEN span ELSE mx END AS anchored_end_ft FROM gh"""))
def absolute_anchors(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    keys = job.groups.select("project_id", "group_id", "source_file", "tokens_key", "min_station_ft")
    return windows.absolute_anchors(job.groups).join(keys, ["project_id", "group_id"]).select(*GID, "anchor_offset_ft", "anchored_start_ft", "anchored_end_ft")


@query("spatial_route_pool", match_sql(*_GROUPS, *ROUTES, *_POOL, "rg AS (SELECT project_id, route_id, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d, avg(lat) AS y, avg(lon) AS x FROM dense GROUP BY 1, 2)", then=f"""
, p AS (SELECT q.*, a, b, c, d, {hav('y', 'x', '30.1605', 'x0')} AS away, b >= 30.16 - 0.00075 AND a <= 30.161 + 0.00075 AND d >= x0 - 0.0005 - 0.00075 AND c <= x0 + 0.0005 + 0.00075 AS touch
  FROM (SELECT *, -96.40 + CAST(substr(project_id, 2) AS BIGINT) * 0.02 + 0.002 AS x0 FROM pool1) q JOIN rg USING (project_id, route_id)),
k AS (SELECT *, fits AND (touch OR away <= 700) AS keep FROM p), z AS (SELECT *, bool_or(keep) OVER (PARTITION BY project_id, source_file, tokens_key, gid) AS any_keep FROM k)
SELECT project_id, source_file, route_id, span AS span_ft, any_keep AS any_kept, round(CASE WHEN any_keep THEN greatest(0, 1 - away / 900) * 0.18 ELSE 0 END, 5) AS spatial_hint, count(*) AS n FROM z WHERE keep OR NOT any_keep GROUP BY 1, 2, 3, 4, 5, 6"""))
def spatial_route_pool(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    x0 = F.lit(-96.40) + F.substring("project_id", 2, 20).cast("long") * 0.02 + 0.002
    spatial = job.groups.select("project_id", "group_id", F.struct(
        F.lit(30.16).alias("min_lat"), F.lit(30.161).alias("max_lat"), (x0 - 0.0005).alias("min_lon"), (x0 + 0.0005).alias("max_lon")).alias("box"),
        F.lit(30.1605).alias("c_lat"), x0.alias("c_lon"))
    pool = cand.route_pool(job.groups, job.catalog, spatial=spatial)
    return pool.groupBy("project_id", "source_file", "route_id", "span_ft", "any_kept", F.round("spatial_hint", 5).alias("spatial_hint")).agg(F.count("*").alias("n"))
