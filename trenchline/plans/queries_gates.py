"""Queries over hypothesis checks, gates and the choice of a match."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import gates, routes
from trenchline.plans.check_sql import ROUTES, hav
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_matching import _GROUPS, _POOL, _WINDOWS, GID, match_sql
from trenchline.plans.registry import query

_BEAR = ("((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) "
         "* cos(radians({d} - {b})))) + 360.0) % 360.0)")

NEIGHBOUR_CTES = [
    f"""ends AS (SELECT project_id, route_id, la[1] AS s_lat, lo[1] AS s_lon, la[-1] AS e_lat, lo[-1] AS e_lon, {_BEAR.format(a='la[1]', b='lo[1]', c='la[2]', d='lo[2]')} AS s_b,
  {_BEAR.format(a='la[-2]', b='lo[-2]', c='la[-1]', d='lo[-1]')} AS e_b FROM (SELECT project_id, route_id, list(lat ORDER BY idx) AS la, list(lon ORDER BY idx) AS lo FROM dense GROUP BY 1, 2))""",
    f"""links AS (SELECT a.project_id, a.route_id AS f, b.route_id AS t, round({hav('b.s_lat', 'b.s_lon', 'a.e_lat', 'a.e_lon')}, 3) AS dist, a.e_b, b.s_b FROM ends a JOIN ends b
  ON a.project_id = b.project_id AND a.route_id <> b.route_id AND {hav('b.s_lat', 'b.s_lon', 'a.e_lat', 'a.e_lon')} <= 3.0)""",
    """trans AS (SELECT l.*, cf.route_role AS fr_role, ct.route_role AS to_role,
   round(least(abs(e_b - s_b) % 360, 360 - abs(e_b - s_b) % 360), 3) AS angle FROM links l JOIN catalog_ cf ON cf.project_id = l.project_id AND cf.route_id = f
   JOIN catalog_ ct ON ct.project_id = l.project_id AND ct.route_id = t)""",
]


def _ok(own: str, other: str) -> str:
    return (f"(({own} = 'underground_cable' AND {other} IN ('underground_cable', 'backbone', 'terminal_tail')) OR ({own} IN ('backbone', 'terminal_tail') AND {other} = 'underground_cable'))")


NEIGHBOUR_CTES += [
    f"""ups AS (SELECT project_id, t AS route_id, count(*) AS n_up, bool_and({_ok('to_role', 'fr_role')}) AS up_ok, min(angle) AS up_angle FROM trans GROUP BY 1, 2)""",
    f"""downs AS (SELECT project_id, f AS route_id, count(*) AS n_down, bool_and({_ok('fr_role', 'to_role')}) AS down_ok FROM trans GROUP BY 1, 2)""",
]


@query("endpoint_neighbours", match_sql(*ROUTES, *NEIGHBOUR_CTES, then="""
SELECT project_id, t AS route_id, 'up' AS side, f AS neighbour, dist AS distance_ft, angle, """ + _ok("to_role", "fr_role") + """ AS type_ok FROM trans
UNION ALL SELECT project_id, f, 'down', t, dist, angle, """ + _ok("fr_role", "to_role") + """ FROM trans"""))
def endpoint_neighbours(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    links = gates.neighbours(job.catalog, routes.terminal_bearings(job.catalog), keep=None)

    def side(name):
        return links.select("project_id", "route_id", F.lit(name).alias("side"), F.explode(name).alias("n")).select(
            "project_id", "route_id", "side", "n.neighbour", "n.distance_ft", "n.angle", "n.type_ok")

    return side("up").unionByName(side("down"))


_K = "project_id, source_file, tokens_key, gid, route_id"
_G = "project_id, source_file, tokens_key, gid"
VERDICT_CTES = [
    """pp AS (SELECT a.*, unnest(range(0, len(fts))) AS pos, ws + unnest(fts) - mn AS rf FROM anch a)""",
    """pd AS (SELECT *, greatest(1e-12, least(rf, total_ft)) AS d FROM pp)""",
    f"""pj AS (SELECT p.project_id, source_file, tokens_key, gid, p.route_id, list(round(a_lat + (b_lat - a_lat) * (d - start_ft) / (end_ft - start_ft), 8) ORDER BY pos) AS la,
  list(round(a_lon + (b_lon - a_lon) * (d - start_ft) / (end_ft - start_ft), 8) ORDER BY pos) AS lo, list(seg_idx ORDER BY pos) AS sg,
  list(chunk_base + least(n_chunks - 1, CAST(floor((d - start_ft) / (end_ft - start_ft) * n_chunks) AS INT)) ORDER BY pos) AS pc
  FROM pd p ASOF JOIN dseg v ON v.project_id = p.project_id AND v.route_id = p.route_id AND p.d > v.start_ft GROUP BY 1, 2, 3, 4, 5)""",
    f"""hv AS (SELECT a.*, la, lo, sg, pc, round(we, 2) AS w2, [round(ws + f - mn, 2) for f in fts] AS pr, fts AS ps,
  [round(greatest(0, least(CASE WHEN span > 0 THEN ws + f - mn ELSE f + ws END, total_ft)), 2) for f in fts] AS mp,
  max(CASE WHEN anchor_rank = 1 THEN combined END) OVER g AS c1, max(CASE WHEN anchor_rank = 2 THEN combined END) OVER g AS c2,
  max(CASE WHEN rank = 1 THEN score END) OVER g AS s1, max(CASE WHEN rank = 2 THEN score END) OVER g AS s2,
  max(CASE WHEN rank = 1 THEN a.route_id END) OVER g AS top_ranked, max(CASE WHEN anchor_rank = 1 THEN a.route_id END) OVER g AS top_anchored,
  coalesce(n_up, 0) AS nu, coalesce(n_down, 0) AS nd, coalesce(up_ok, true) AS uok, coalesce(down_ok, true) AS dok
  FROM anch a JOIN pj USING ({_K}) LEFT JOIN ups u ON u.project_id = a.project_id AND u.route_id = a.route_id LEFT JOIN downs dn ON dn.project_id = a.project_id AND dn.route_id = a.route_id
  WINDOW g AS (PARTITION BY a.project_id, source_file, tokens_key, gid))""",
    """hw AS (SELECT *, len(pr) AS np_, [mp[i + 1] - mp[i] for i in range(1, len(mp))] AS md, [fts[i + 1] - fts[i] for i in range(1, len(fts))] AS sd,
  [pr[i + 1] - pr[i] for i in range(1, len(pr))] AS rd, [ps[i + 1] - ps[i] for i in range(1, len(ps))] AS psd, [abs(pc[i + 1] - pc[i]) for i in range(1, len(pc))] AS pjump,
  round(CASE WHEN c2 IS NULL THEN 1.0 ELSE c1 - c2 END, 6) AS lead_, ws <= 15 AS ns, round(length_ft - w2, 6) <= 15 AS ne FROM hv)""",
    """hx AS (SELECT *, [round(md[i] / sd[i], 9) for i in range(1, len(md) + 1) if sd[i] > 0] AS rt, [x for x in rd if x > 0] AS up_, [round(rd[i] / psd[i], 9) for i in range(1, len(rd) + 1) if psd[i] > 0] AS rates,
  CASE WHEN len(mp) >= 2 AND span > 0 THEN round(abs(mp[-1] - mp[1] - span) / span, 9) END AS drift,
  greatest(len([m for m in mp if m <= 5]), len([m for m in mp if round(abs(length_ft - m), 6) <= 5])) AS edges,
  len(list_distinct([{'a': round(la[i], 7), 'b': round(lo[i], 7)} for i in range(1, len(la) + 1)])) AS places FROM hw)""",
    """hy AS (SELECT *, CASE WHEN lead_ < 0.02 THEN 'fail' WHEN lead_ < 0.05 THEN 'warn' ELSE 'pass' END AS c_ambiguity,
  CASE WHEN len([x for x in md if x <= 0]) > 0 THEN 'fail' ELSE 'pass' END AS c_monotone,
  CASE WHEN drift > 0.35 THEN 'fail' WHEN drift > 0.15 THEN 'warn' ELSE 'pass' END AS c_span,
  CASE WHEN list_min(rt) < 0.5 OR list_max(rt) > 1.75 THEN 'fail' WHEN list_min(rt) < 0.8 OR list_max(rt) > 1.25 THEN 'warn' ELSE 'pass' END AS c_spacing,
  CASE WHEN edges >= 2 THEN 'warn' ELSE 'pass' END AS c_edge FROM hx)""",
    """hz AS (SELECT *, CASE WHEN 'fail' IN (c_ambiguity, c_monotone, c_span, c_spacing) THEN 'fail' WHEN 'warn' IN (c_ambiguity, c_span, c_spacing, c_edge) THEN 'warn' ELSE 'pass' END AS status,
  array_to_string(list_filter([CASE WHEN c_monotone <> 'pass' THEN 'mapped_station_monotonicity=' || c_monotone END, CASE WHEN c_span <> 'pass' THEN 'span_integrity=' || c_span END,
   CASE WHEN c_spacing <> 'pass' THEN 'spacing_distortion=' || c_spacing END, CASE WHEN span > 0 AND round((w2 - ws) / span, 6) < 0.9 THEN 'segment_coverage_ratio' END,
   CASE WHEN places < greatest(3, CAST(floor(np_ * 0.65) AS INT)) THEN 'projected_points_clamped' END], lambda x: x IS NOT NULL), ';') AS billing,
  CASE WHEN span <= 0 THEN 'within_physical_span_bounds' WHEN length_ft < span * 0.85 THEN 'route_too_short_for_bore_span' WHEN length_ft > span * 3.5 THEN 'route_too_long_for_bore_span' ELSE 'within_physical_span_bounds' END AS g_feasible,
  CASE WHEN np_ < 4 THEN 'insufficient_projected_points' WHEN list_min(rd) <= 0 THEN 'non_monotonic_route_progress' WHEN list_max(pr) - list_min(pr) < 250 THEN 'insufficient_route_progress'
   WHEN len(list_distinct(sg)) <= 1 AND np <= 1 THEN 'single_segment_route_geometry'
   WHEN round(len(list_distinct(pc)) / greatest(1, np_ - 1), 9) < 0.2 AND round(len(list_distinct(pc)) / greatest(1, np), 9) < 0.2 THEN 'low_unique_segment_ratio'
   WHEN list_max(pjump) > 2 THEN 'segment_jump_too_large' ELSE 'segment_fit_valid' END AS g_segment,
  CASE WHEN np_ < 2 OR span <= 0 THEN 'insufficient_boundary_points' WHEN round(abs(list_max(pr) - list_min(pr) - span), 6) > 10 THEN 'projected_span_out_of_tolerance'
   WHEN round(abs(pr[1] - ws), 6) > 10 THEN 'start_boundary_out_of_tolerance' WHEN round(abs(pr[-1] - w2), 6) > 10 THEN 'end_boundary_out_of_tolerance'
   WHEN len([x for x in pr if round(ws - x, 6) > 5 OR round(x - w2, 6) > 5]) > 0 THEN 'projected_points_outside_segment_bounds' ELSE 'boundary_exactness_valid' END AS g_boundary,
  CASE WHEN np_ < 3 THEN 'insufficient_points_for_continuity' WHEN list_min(rd) < -0.01 THEN 'route_overlap_detected' WHEN len([x for x in rd if x <= 0.01]) / len(rd) > 0.2 THEN 'too_many_repeated_steps'
   WHEN round(list_max(up_), 6) > 80 THEN 'route_gap_too_large' WHEN round(list_min(up_), 6) < 5 THEN 'route_gap_too_small' WHEN list_max(rates) > 1.75 THEN 'route_station_gap_ratio_too_large'
   WHEN list_min(rates) < 0.25 THEN 'route_station_gap_ratio_too_small' ELSE 'continuity_valid' END AS g_continuity,
  CASE WHEN NOT (ns OR ne) THEN 'chain_valid' WHEN np_ < 3 THEN 'insufficient_points_for_chain_validation' WHEN nu + nd > 1 THEN 'multiple_possible_chain_links'
   WHEN ns AND nu = 0 THEN 'missing_upstream_chain_link' WHEN ne AND nd = 0 THEN 'missing_downstream_chain_link' WHEN (ns AND NOT uok) OR (ne AND NOT dok) THEN 'invalid_chain_type_transition' ELSE 'chain_valid' END AS g_chain FROM hy)""",
    """verd AS (SELECT *, CASE WHEN g_chain = 'chain_valid' THEN 'node_resolution_valid' ELSE 'chain_gate_failed_first' END AS g_node,
  billing = '' AND g_feasible = 'within_physical_span_bounds' AND g_segment IN ('segment_fit_valid', 'single_segment_route_geometry') AND g_boundary = 'boundary_exactness_valid'
   AND g_continuity = 'continuity_valid' AND g_chain = 'chain_valid' AS b0 FROM hz)""",
]
_ALL = [*_GROUPS, *ROUTES, *_POOL, *_WINDOWS, *NEIGHBOUR_CTES, *VERDICT_CTES]


@query("hypothesis_verdicts", match_sql(*_ALL, then="""SELECT project_id, source_file, tokens_key, mn AS min_station_ft, route_id, c_ambiguity, c_monotone, c_span, c_spacing, c_edge, status,
  CASE status WHEN 'fail' THEN 'LOW' WHEN 'warn' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence_label,
  CASE WHEN c_ambiguity = 'fail' THEN 'AMBIGUOUS_MATCH' WHEN c_monotone = 'fail' THEN 'STATION_NORMALIZATION_ISSUE' WHEN c_spacing = 'fail' THEN 'RIGHT_ROUTE_WRONG_SCALING'
   WHEN c_span = 'fail' THEN 'RIGHT_ROUTE_WRONG_POSITION' END AS failure_class, billing AS billing_reasons, g_feasible, g_segment, g_boundary, g_continuity, g_chain, g_node FROM verd"""))
def hypothesis_verdicts(spark, sf_dir):
    billing = F.array_join(F.transform("billing_reasons", lambda t: F.regexp_replace(t, "^segment_coverage_ratio=.*$", "segment_coverage_ratio")), ";")
    return Job.of(spark, sf_dir).verdicts.select(
        *GID, "route_id", "c_ambiguity", "c_monotone", "c_span", "c_spacing", "c_edge", "status", "confidence_label", "failure_class",
        billing.alias("billing_reasons"), *[F.col(f"{g}.reason").alias(g) for g in gates.ROW_GATES])


_D = ("(364000.0 * sqrt(pow((p.lon - a_lon - (b_lon - a_lon) * tt) * ee, 2) + pow(p.lat - a_lat - (b_lat - a_lat) * tt, 2)))")
CHOICE_CTES = [
    f"""u1 AS (SELECT *, first(route_id) OVER x AS uw, first(wscore) OVER x AS uws, first(combined) OVER x AS uwc FROM verd
  WINDOW x AS (PARTITION BY {_G} ORDER BY CASE WHEN b0 THEN 0 ELSE 1 END, wscore DESC, combined DESC, score DESC, route_id))""",
    f"""u2 AS (SELECT *, b0 AND route_id <> uw AND (round(uws - wscore, 6) < 0.08 OR round(uwc - combined, 6) < 0.06) AS rival FROM u1)""",
    f"""u3 AS (SELECT *, bool_or(rival) OVER (PARTITION BY {_G}) AND (rival OR (b0 AND route_id = uw)) AS u_lost FROM u2)""",
    f"""u4 AS (SELECT *, b0 AND NOT u_lost AS b1, CASE WHEN top_ranked = top_anchored AND (round(s1 - coalesce(s2, 0), 6) >= 0.03 OR round(c1 - coalesce(c2, 0), 6) >= 0.03) THEN top_ranked END AS consensus FROM u3)""",
    f"""u5 AS (SELECT *, b1 AND NOT coalesce(route_id <> consensus, false) AS b2 FROM u4)""",
    f"""u6 AS (SELECT *, CASE WHEN bool_or(b2) OVER (PARTITION BY {_G}) THEN first(route_id) OVER (PARTITION BY {_G} ORDER BY CASE WHEN b2 THEN 0 ELSE 1 END, wscore DESC, combined DESC, route_id) END AS lw FROM u5)""",
    f"""lockp AS (SELECT {_G}, unnest(la) AS lat, unnest(lo) AS lon, generate_subscripts(la, 1) AS pos FROM u6 WHERE route_id = lw)""",
    f"""lockd AS (SELECT o.project_id, o.source_file, o.tokens_key, o.gid, o.route_id, pos, min({_D}) AS dist FROM u6 o JOIN lockp p USING ({_G}) JOIN dseg s ON s.project_id = o.project_id AND s.route_id = o.route_id,
   LATERAL (SELECT greatest(0.2, cos(radians((p.lat + a_lat + b_lat) / 3))) AS ee) e, LATERAL (SELECT least(1, greatest(0, ((p.lon - a_lon) * (b_lon - a_lon) * ee * ee + (p.lat - a_lat) * (b_lat - a_lat))
     / (pow((b_lon - a_lon) * ee, 2) + pow(b_lat - a_lat, 2)))) AS tt) f WHERE o.b2 AND o.route_id <> lw GROUP BY 1, 2, 3, 4, 5, 6)""",
    f"""lockc AS (SELECT {_G}, bool_or(par) AS conflict FROM (SELECT {_G}, route_id, count(*) FILTER (dist <= 18) / count(*) >= 0.75 AND avg(dist) <= 15 AND max(dist) <= 28 AS par FROM lockd GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)""",
    f"""u7 AS (SELECT u6.*, coalesce(route_id = lw, false) AND (np_ < 3 OR coalesce(conflict, false)) AS lock_lost, coalesce(route_id = consensus, false) AS committed FROM u6 LEFT JOIN lockc USING ({_G}))""",
    f"""u8 AS (SELECT *, b2 AND NOT lock_lost AS billable, bool_or(committed) OVER (PARTITION BY {_G}) AS agreed FROM u7)""",
    f"""ev AS (SELECT *, CASE WHEN agreed THEN row_number() OVER (PARTITION BY {_G} ORDER BY committed DESC, billable DESC, score DESC, combined DESC, wscore DESC, route_name, route_id)
   ELSE row_number() OVER (PARTITION BY {_G} ORDER BY billable DESC, wscore DESC, combined DESC, score DESC, route_name, route_id) END AS eval_rank,
   status = 'pass' AND g_chain = 'multiple_possible_chain_links' AND g_feasible = 'within_physical_span_bounds' AND g_continuity = 'continuity_valid'
    AND g_segment IN ('segment_fit_valid', 'single_segment_route_geometry') AND g_boundary = 'boundary_exactness_valid' AND (consensus IS NULL OR committed) AS preview_safe,
   coalesce(list_max(md) > 0, false) AS has_geometry FROM u8)""",
    """rend AS (SELECT *, has_geometry AND (g_chain = 'chain_valid' OR preview_safe) AS render_allowed FROM ev)""",
]


@query("evaluated_matches", match_sql(*_ALL, *CHOICE_CTES, then="""SELECT project_id, source_file, tokens_key, mn AS min_station_ft, route_id, billable, eval_rank, consensus AS consensus_route, committed, u_lost, lock_lost,
  preview_safe, has_geometry, render_allowed FROM rend"""))
def evaluated_matches(spark, sf_dir):
    return Job.of(spark, sf_dir).evaluated.select(
        *GID, "route_id", "billable", "eval_rank", "consensus_route", "committed", "u_lost", "lock_lost", "preview_safe", "has_geometry", "render_allowed")


@query("group_render_reasons", match_sql(*_ALL, *CHOICE_CTES, then="""SELECT project_id, source_file, tokens_key, mn AS min_station_ft, route_id,
  array_to_string(list_filter([CASE WHEN NOT has_geometry THEN 'no_geometry_output' END, CASE WHEN g_chain <> 'chain_valid' AND NOT preview_safe THEN g_chain END], lambda x: x IS NOT NULL), ';') AS stops,
  CASE WHEN render_allowed THEN array_to_string(list_filter([CASE WHEN preview_safe THEN 'chain_gate:multiple_possible_chain_links;node_resolution_gate:chain_gate_failed_first;endpoint_chain_ambiguity_preview_only' END,
    CASE WHEN g_feasible <> 'within_physical_span_bounds' THEN g_feasible END, CASE WHEN g_continuity <> 'continuity_valid' THEN g_continuity END,
    CASE WHEN g_segment NOT IN ('segment_fit_valid', 'single_segment_route_geometry') THEN g_segment END], lambda x: x IS NOT NULL), ';') ELSE '' END AS review FROM rend WHERE eval_rank = 1"""))
def group_render_reasons(spark, sf_dir):
    won = Job.of(spark, sf_dir).evaluated.where("eval_rank = 1")
    stops = F.when(F.col("render_allowed"), F.lit("")).otherwise(F.array_join(F.filter(
        "block_reasons", lambda r: (r == "no_geometry_output") | (r == F.col("g_chain.reason"))), ";"))
    return won.select(*GID, "route_id", stops.alias("stops"), F.array_join("review_reasons", ";").alias("review"))
