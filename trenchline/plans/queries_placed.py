"""As-built output of the real match, claims laid by a rule that both engines can follow.

Settling claims is a loop that SQL cannot follow, so these queries lay each group on its best
anchored window instead; everything after that (points, stretches, coverage, money, conflicts,
summaries) is the code that settled claims go through, held against plain SQL by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trenchline.operators import coverage as cov
from trenchline.operators import ownership, reports, routes
from trenchline.plans.check_sql import ROUTES
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_geometry import r
from trenchline.plans.queries_matching import GROUP_CTES, POOL_CTES, WINDOW_CTES, match_sql
from trenchline.plans.queries_outputs import _union
from trenchline.plans.registry import query

KEY = routes.KEY
ID = ["project_id", "group_id"]


class Placed:
    """Groups named by file, prints and first station, and their claims."""

    def __init__(self, spark, sf_dir: str):
        self.job = Job.of(spark, sf_dir)
        name = F.concat_ws("|", "source_file", "tokens_key", F.col("min_station_ft").cast("bigint"))
        named = self.job.groups.withColumnRenamed("group_id", "own_id").withColumn("group_id", name)
        ids = named.select("project_id", "own_id", "group_id")
        self.groups = named.drop("own_id")
        best = self.job.anchored.where("anchor_rank = 1").select("project_id", F.col("group_id").alias("own_id"), "route_id", "start_ft", r("end_ft", 2), "window_score", "combined")
        self.claims = best.join(ids, ["project_id", "own_id"]).drop("own_id").join(self.groups.select(*ID, "row_count"), ID).withColumns({
            "accepted": F.col("row_count") % 4 != 0, "reason": F.lit("placed"), "committed": F.col("combined") >= 0.8,
            "status": F.when(F.col("row_count") % 3 == 0, "warn").when(F.col("row_count") % 3 == 1, "fail").otherwise("pass")}).drop("row_count")
        self.ranked = self.job.ranked.withColumnRenamed("group_id", "own_id").join(ids, ["project_id", "own_id"]).drop("own_id")


_CLAIMS = [*GROUP_CTES, *ROUTES, *POOL_CTES, *WINDOW_CTES,
           """pl AS (SELECT *, concat(source_file, '|', tokens_key, '|', CAST(CAST(mn AS BIGINT) AS VARCHAR)) AS group_id, ws AS start_ft, round(we, 2) AS end_ft, n_rows % 4 <> 0 AS accepted,
  combined >= 0.8 AS committed, CASE n_rows % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' ELSE 'pass' END AS status FROM anch WHERE anchor_rank = 1)""",
           """gr AS (SELECT f.project_id, f.source_file, f.tokens_key, f.gid, f.ft, k.station, k.depth_ft, k.boc_ft, k.notes, k.crew, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY f.project_id, f.source_file, f.tokens_key, f.gid) AS rows_in
  FROM fold f JOIN kn k USING (project_id, source_file, tokens_key, n) WINDOW w AS (PARTITION BY f.project_id, f.source_file, f.tokens_key, f.gid ORDER BY f.ft))""",
           """pr AS (SELECT p.*, g.ft, g.station, g.depth_ft, g.boc_ft, g.notes, g.crew, g.pos, g.rows_in,
  greatest(0, least(CASE WHEN total_ft > 0 AND span > 0 THEN start_ft + greatest(g.ft - mn, 0) ELSE g.ft + start_ft END, total_ft)) AS at_ft
  FROM pl p JOIN gr g USING (project_id, source_file, tokens_key, gid) WHERE accepted)""",
           """ps AS (SELECT * FROM (SELECT project_id, route_id, route_name, group_id, source_file, pos + 1 AS row_index, ft, lead(ft) OVER w AS next_ft, at_ft AS s, lead(at_ft) OVER w AS e, depth_ft, boc_ft, crew
  FROM pr WINDOW w AS (PARTITION BY project_id, group_id ORDER BY pos)) WHERE e > s)"""]


def placed_sql(*parts: str, then: str) -> str:
    return match_sql(*_CLAIMS, *parts, then=then)


@query("placed_points", placed_sql(then="""
SELECT p.project_id, p.route_id, group_id, pos, CASE WHEN pos = 0 THEN 'start' WHEN pos = rows_in - 1 THEN 'end' ELSE 'station' END AS point_role, ft AS station_ft, depth_ft, boc_ft, notes, crew,
  round(at_ft, 2) AS mapped_ft, round(round(a_lat + (b_lat - a_lat) * (d - v.start_ft) / (v.end_ft - v.start_ft), 8), 6) AS lat, round(round(a_lon + (b_lon - a_lon) * (d - v.start_ft) / (v.end_ft - v.start_ft), 8), 6) AS lon
FROM (SELECT *, greatest(1e-12, at_ft) AS d FROM pr) p ASOF JOIN dseg v ON v.project_id = p.project_id AND v.route_id = p.route_id AND p.d > v.start_ft"""))
def placed_points(spark, sf_dir):
    """Station points (role, mapped feet, place) of claims on their best window."""
    p = Placed(spark, sf_dir)
    dense = p.job.catalog.select(*KEY, F.posexplode(F.arrays_zip("coords", "chain")).alias("idx", "c")).select(
        *KEY, "idx", "c.coords.lat", "c.coords.lon", F.col("c.chain").alias("chain_ft"))
    found = cov.station_points(p.claims, p.groups, p.job.catalog, routes.route_segments(dense))
    return found.select(*KEY, "group_id", "pos", "point_role", "station_ft", "depth_ft", "boc_ft", "notes", "crew", "mapped_ft", r("lat", 6), r("lon", 6))


def built(p: Placed) -> DataFrame:
    return cov.built_segments(p.claims, p.groups, p.job.catalog)


@query("placed_segments", placed_sql(then="""
SELECT project_id, route_id, route_name, group_id, source_file, row_index, round(s, 2) AS start_ft, round(e, 2) AS end_ft, round(e - s, 2) AS length_ft, depth_ft, boc_ft, crew FROM ps"""))
def placed_segments(spark, sf_dir):
    """Stretches between consecutive rows."""
    return built(Placed(spark, sf_dir)).select(*KEY, "route_name", "group_id", "source_file", "row_index", "start_ft", "end_ft", "length_ft", "depth_ft", "boc_ft", "crew")


@query("placed_billing", placed_sql("bs AS (SELECT project_id, route_id, round(s, 2) AS start_ft, round(e, 2) AS end_ft FROM ps)", _union("bs", 5.0), then="""
, cv AS (SELECT project_id, route_id, count(*) AS m, round(sum(e - s), 2) AS u FROM un GROUP BY 1, 2)
SELECT project_id, route_id, length_ft, coalesce(m, 0) AS merged_count, coalesce(u, 0) AS unique_length_ft, round(round(coalesce(u, 0) / length_ft * 100, 8), 2) AS completion_pct,
  CAST(round(CAST(coalesce(u, 0) AS DECIMAL(15,2)) * CAST(3.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS material_total, CAST(round(CAST(coalesce(u, 0) AS DECIMAL(15,2)) * CAST(1.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS splicing_total, CAST(round(CAST(coalesce(u, 0) AS DECIMAL(15,2)) * CAST(5.0 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS grand_total
FROM catalog_ LEFT JOIN cv USING (project_id, route_id)"""))
def placed_billing(spark, sf_dir):
    """Unique covered feet and money of every route, through groups, candidates and windows."""
    p = Placed(spark, sf_dir)
    covered = cov.coverage(built(p)).select(*KEY, "merged_count", "unique_length_ft")
    feet = F.coalesce("unique_length_ft", F.lit(0.0))
    return p.job.catalog.select(*KEY, "length_ft").join(covered, KEY, "left").select(
        *KEY, "length_ft", F.coalesce("merged_count", F.lit(0)).alias("merged_count"), feet.alias("unique_length_ft"),
        F.round(F.round(feet / F.col("length_ft") * 100, 8), 2).alias("completion_pct"), *cov.billing(feet))


@query("placed_conflicts", placed_sql(
    "cp AS (SELECT p.*, g.sheets AS sh, g.streets AS stt FROM pl p JOIN gh g USING (project_id, source_file, tokens_key, gid) WHERE accepted)",
    """cj AS (SELECT a.project_id, a.route_id, a.group_id AS a_group_id, b.group_id AS b_group_id, least(a.end_ft, b.end_ft) - greatest(a.start_ft, b.start_ft) AS o,
  greatest(1, a.end_ft - a.start_ft) AS sa, greatest(1, b.end_ft - b.start_ft) AS sb, abs((a.start_ft + a.end_ft) / 2 - (b.start_ft + b.end_ft) / 2) AS gap,
  abs(CAST(a.start_ft AS DECIMAL(15,2)) + CAST(a.end_ft AS DECIMAL(15,2)) - CAST(b.start_ft AS DECIMAL(15,2)) - CAST(b.end_ft AS DECIMAL(15,2))) * CAST(0.5 AS DECIMAL(2,1)) AS exact_gap,
  list_min(flatten([[abs(x - y) for y in b.sh] for x in a.sh])) AS sheet_gap, len(a.sh) + len(b.sh) = 0 AS no_sheets,
  len(list_intersect([upper(trim(x)) for x in a.stt], [upper(trim(x)) for x in b.stt])) > 0 AS same_street
  FROM cp a JOIN cp b ON a.project_id = b.project_id AND a.route_id = b.route_id AND a.group_id < b.group_id WHERE least(a.end_ft, b.end_ft) > greatest(a.start_ft, b.start_ft))""",
    "ck AS (SELECT *, least(sa, sb) AS l, gap <= greatest(25, least(sa, sb) * 0.1) AS near FROM cj)", then="""
SELECT project_id, route_id, a_group_id, b_group_id, round(o, 2) AS overlap_ft, round(o / l, 6) AS overlap_ratio, CAST(round(exact_gap, 2) AS DOUBLE) AS centre_gap_ft, round(l / greatest(sa, sb), 6) AS span_similarity, near AS near_duplicate,
  o > least(30, greatest(5, l * 0.06)) AND (o / l >= 0.12 OR near) AS conflict,
  coalesce(sheet_gap <= 1, false) OR (same_street AND (coalesce(sheet_gap <= 2, false) OR no_sheets)) AS same_zone FROM ck"""))
def placed_conflicts(spark, sf_dir):
    """Overlapping claims on a route, how much they overlap, and whether they lie in one print zone."""
    p = Placed(spark, sf_dir)
    zones = p.claims.where("accepted").join(p.groups.select(*ID, "sheets", "streets"), ID)
    return ownership.conflict_pairs(zones).select("project_id", "route_id", "a_group_id", "b_group_id", "overlap_ft", "overlap_ratio", "centre_gap_ft", "span_similarity",
                                                  "near_duplicate", "conflict", "same_zone")


@query("placed_summary", placed_sql(then="""
SELECT project_id, count(*) AS group_count, count(DISTINCT CASE WHEN accepted THEN route_id END) AS unique_matched_routes, count_if(accepted)::BIGINT AS rendered_group_count,
  count_if(NOT accepted)::BIGINT AS blocked_group_count, count_if(status = 'warn')::BIGINT AS warn_count, count_if(status = 'fail')::BIGINT AS fail_count FROM pl GROUP BY 1"""))
def placed_summary(spark, sf_dir):
    p = Placed(spark, sf_dir)
    return reports.batch_summary(p.claims, p.claims)


@query("placed_match", placed_sql(then="""
SELECT project_id, group_id, route_id, round(combined, 3) AS confidence FROM (
  SELECT concat(project_id, '/', source_file, '/', tokens_key) AS project_id, group_id, route_id, combined, committed, n_rows, min(route_id) OVER f AS low, max(route_id) OVER f AS high FROM pl WHERE accepted WINDOW f AS (PARTITION BY project_id, source_file, tokens_key))
WHERE low = high QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY committed DESC, n_rows DESC, round(combined, 3) DESC, group_id) = 1"""))
def placed_match(spark, sf_dir):
    """The one match to show, each print of a file being a job of its own, for those on one route."""
    p = Placed(spark, sf_dir)
    own = F.concat_ws("/", "project_id", "source_file", "tokens_key")
    groups = p.groups.withColumn("project_id", own)
    claims = p.claims.join(p.groups.select(*ID, "source_file", "tokens_key"), ID).withColumn("project_id", own).drop("source_file", "tokens_key")
    return reports.selected_match(claims, claims.drop("committed"), groups)


@query("placed_payload", placed_sql(
    "rp AS (SELECT project_id, source_file, tokens_key, gid, string_agg(concat(rank, ':', route_id), ' ' ORDER BY rank) AS preview FROM ranked WHERE rank <= 3 GROUP BY ALL)", then="""
SELECT project_id, group_id, source_file, n_rows AS row_count, mn AS min_station_ft, mn + span AS max_station_ft, status, route_id, accepted, preview FROM pl LEFT JOIN rp USING (project_id, source_file, tokens_key, gid)"""))
def placed_payload(spark, sf_dir):
    """Compact row per group with its three best routes."""
    p = Placed(spark, sf_dir)
    none = F.lit(None).cast("string")
    selected = p.claims.withColumns({"confidence_label": none, "consensus_route": none, "block_reasons": none, "review_reasons": none})
    full = reports.group_payload(p.groups, selected, p.claims, p.ranked)
    listed = F.array_join(F.transform("preview", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["route_id"])), " ")
    return full.select(*ID, "source_file", "row_count", "min_station_ft", "max_station_ft", "status", "route_id", "accepted", listed.alias("preview"))


@query("placed_debug", placed_sql(
    "rd AS (SELECT project_id, source_file, tokens_key, gid, string_agg(concat(rank, ':', route_id, ':', printf('%.6f', score), ':', printf('%.6f', base_score), ':', printf('%.6f', family_bonus)), ' ' ORDER BY rank) AS routes FROM ranked GROUP BY ALL)",
    """hd AS (SELECT project_id, source_file, tokens_key, gid, string_agg(concat(anchor_rank, ':', route_id, ':', printf('%.2f', ws), ':', printf('%.6f', wscore), ':', printf('%.6f', combined)), ' ' ORDER BY anchor_rank) AS tried FROM anch GROUP BY ALL)""", then="""
SELECT p.project_id, group_id, source_file, n_rows AS row_count, span AS span_ft, routes, tried FROM pl p LEFT JOIN rd USING (project_id, source_file, tokens_key, gid) LEFT JOIN hd USING (project_id, source_file, tokens_key, gid)"""))
def placed_debug(spark, sf_dir):
    """Debugging record of each group: ranked routes with parts of their scores, and windows tried."""
    p = Placed(spark, sf_dir)
    names = p.job.groups.select("project_id", "group_id", F.concat_ws("|", "source_file", "tokens_key", F.col("min_station_ft").cast("bigint")).alias("name"))
    null = F.lit(None)
    tried = p.job.anchored.select(*ID, F.col("anchor_rank").alias("eval_rank"), "route_id", "start_ft", "end_ft", "window_score", "combined", null.cast("string").alias("status"),
                                  null.cast("boolean").alias("billable"), null.cast("string").alias("reasons"), null.cast("string").alias("g_chain"), null.cast("string").alias("g_node"))
    full = reports.match_debug(p.job.groups, p.job.ranked, tried).join(names, ID)

    def text(x, *parts):
        return F.concat_ws(":", *(F.format_string(fmt, x[c]) if fmt else x[c].cast("string") for c, fmt in parts))

    routes_ = F.transform("candidate_routes", lambda x: text(x, ("rank", None), ("route_id", None), ("score", "%.6f"), ("base_score", "%.6f"), ("family_bonus", "%.6f")))
    windows_ = F.transform("hypotheses", lambda x: text(x, ("eval_rank", None), ("route_id", None), ("start_ft", "%.2f"), ("window_score", "%.6f"), ("combined", "%.6f")))
    return full.select("project_id", F.col("name").alias("group_id"), "source_file", "row_count", "span_ft", F.array_join(routes_, " ").alias("routes"), F.array_join(windows_, " ").alias("tried"))
