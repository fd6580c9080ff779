"""Queries from design-sheet text to the filtered route pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import corridors as cor
from trenchline.plans.inputs import cte, view, with_views
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_quality import clean_rows
from trenchline.plans.queries_text import feet_sql
from trenchline.plans.registry import query
from trenchline.session import cut_lineage


def facts(spark, sf_dir):
    return cor.page_facts(view(spark, sf_dir, "design_pages"))


def segments(spark, sf_dir):
    return cor.corridor_segments(facts(spark, sf_dir))


# the check works from the fields the pages were written with, not from their text
_PAGE = cte("design_pages") + """, pg AS (SELECT p.*, CAST(p.doc_id % 30 + 1 AS VARCHAR) AS sheet_id, CAST(p.doc_id % 20 * 100 AS DOUBLE) AS s, CAST((p.doc_id % 20 + 3) * 100 + 50 AS DOUBLE) AS e,
  CAST(p.doc_id % 30 + 2 AS VARCHAR) AS nxt, p.doc_id % 4 = 0 AS eq, concat('E ', upper(d.lang), ' ST') AS street FROM design_pages p JOIN documents d ON d.doc_id = p.doc_id),
sg AS (SELECT *, concat('corr_', source_file, '_', page_number, '_1') AS corridor_id, CASE WHEN eq AND e <= 640 THEN concat('sheet_', sheet_id, '_branch_1') ELSE concat('sheet_', sheet_id, '_main') END AS chain_id,
  CASE WHEN eq AND e <= 640 THEN 740.0 END AS parent FROM pg)"""


@query("page_facts", "WITH " + _PAGE + """SELECT doc_id, sheet_id, CASE WHEN eq THEN 1 ELSE 0 END AS n_equations, CASE WHEN eq THEN 740.0 END AS parent_ft, 1 AS n_matchlines, e AS matchline_ft, nxt AS see_sheet FROM pg""")
def page_facts(spark, sf_dir):
    first = F.get("matchlines", F.lit(0))
    return facts(spark, sf_dir).select(
        "doc_id", "sheet_id", F.size("equations").alias("n_equations"), F.get("equations", F.lit(0))["parent_ft"].alias("parent_ft"),
        F.size("matchlines").alias("n_matchlines"), F.get(first["stations"], F.lit(0)).alias("matchline_ft"), first["see_sheet"].alias("see_sheet"))


# the street and the label that the pages were written with
@query("sheet_extracts", "WITH " + cte("design_pages") + """
SELECT p.doc_id, concat('SHEET ', p.doc_id % 30 + 1, ' OF 30 E ', upper(d.lang), ' ST') AS streets,
  CASE p.doc_id % 3 WHEN 0 THEN 'PROP. SPLICE POINT 12' WHEN 1 THEN 'VACANT HDPE' ELSE '288CT FIBER OPTIC CABLE' END AS context
FROM design_pages p JOIN documents d ON d.doc_id = p.doc_id""")
def sheet_extracts(spark, sf_dir):
    from trenchline.functions import text as tx

    context = F.regexp_extract_all("compact_text", F.lit(tx.CONTEXT), F.lit(0))
    return facts(spark, sf_dir).select("doc_id", F.array_join("streets", "|").alias("streets"), F.array_join(context, "|").alias("context"))


@query("corridor_segments", "WITH " + _PAGE + """SELECT project_id, corridor_id, sheet_id, chain_id, s AS start_ft, e AS end_ft, parent AS equation_parent_ft, CAST(NULL AS VARCHAR) AS sheet_before, nxt AS sheet_after,
  concat(CAST(doc_id % 20 AS VARCHAR), 'xx') AS station_bucket FROM sg""")
def corridor_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("project_id", "corridor_id", "sheet_id", "chain_id", "start_ft", "end_ft", "equation_parent_ft",
                                          "sheet_before", "sheet_after", "station_bucket")


@query("corridor_edges", "WITH " + _PAGE + """, ch AS (SELECT project_id, corridor_id, lag(corridor_id) OVER w AS p, lead(corridor_id) OVER w AS n FROM sg WINDOW w AS (PARTITION BY project_id, chain_id ORDER BY s, e, page_number, corridor_id))
SELECT project_id, corridor_id AS src, p AS dst FROM ch WHERE p IS NOT NULL UNION SELECT project_id, corridor_id, n FROM ch WHERE n IS NOT NULL
UNION SELECT a.project_id, a.corridor_id, b.corridor_id FROM sg a JOIN sg b ON a.project_id = b.project_id AND a.corridor_id <> b.corridor_id AND (b.sheet_id = a.nxt OR a.sheet_id = b.nxt)
  AND (abs(b.s - a.e) <= 10 OR abs(b.e - a.s) <= 10)""")
def corridor_edges(spark, sf_dir):
    return cor.corridor_edges(segments(spark, sf_dir))


def logs(spark, sf_dir):
    return cor.log_contexts(clean_rows(spark, sf_dir).withColumn("row_no", F.col("station_ft")))


_MATCH = _PAGE + ", " + cte("bore_rows") + f""", lw AS (SELECT project_id, source_file, min({feet_sql('station')}) AS mn, max({feet_sql('station')}) AS mx, max({feet_sql('station')}) - min({feet_sql('station')}) AS span,
  bool_or(notes = 'hard rock') AS rocky FROM bore_rows GROUP BY 1, 2),
sc AS (SELECT l.*, corridor_id, sheet_id, chain_id, s, e, parent, page_text, street, doc_id, greatest(0, least(e, mx) - greatest(s, mn)) AS ov, CASE WHEN rocky AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS shared FROM lw l JOIN sg USING (project_id)),
sr AS (SELECT *, round(ov / greatest(span, 1) * 650 - abs(e - s - span) * 0.55 + CASE WHEN s <= mn + 5 AND e >= mx - 5 THEN 240 WHEN ov > 0 THEN 120 ELSE 0 END + CASE WHEN mx <= parent THEN 90 ELSE 0 END + shared * 24, 4) AS raw FROM sc),
rk AS (SELECT *, round((raw - min(raw) OVER g) / greatest(max(raw) OVER g - min(raw) OVER g, 1e-9), 4) AS confidence, row_number() OVER o AS rank, lead(raw) OVER o AS second FROM sr
  WINDOW g AS (PARTITION BY project_id, source_file), o AS (PARTITION BY project_id, source_file ORDER BY raw DESC, corridor_id)),
mt AS (SELECT *, CASE WHEN rank = 1 THEN round((raw - coalesce(second, raw)) / greatest(abs(raw), 1), 4) END AS margin FROM rk WHERE rank <= 8)"""


@query("corridor_matches", "WITH " + _MATCH + """SELECT project_id, source_file, corridor_id, rank, round(ov, 2) AS overlap_ft, round(ov / greatest(span, 1), 4) AS containment, shared AS shared_words, raw AS raw_score, confidence, margin,
  coalesce((confidence >= 0.68 AND margin >= 0.08) OR (confidence >= 0.84 AND margin >= 0.03), false) AS strong, parent IS NOT NULL AS station_reset FROM mt""")
def corridor_matches(spark, sf_dir):
    return cor.match_corridors(logs(spark, sf_dir), segments(spark, sf_dir)).select(
        "project_id", "source_file", "corridor_id", "rank", "overlap_ft", "containment", "shared_words", "raw_score", "confidence", "margin", "strong", "station_reset")


def gated(spark, sf_dir):
    from trenchline.functions import text as tx

    job = Job.of(spark, sf_dir)
    best = cut_lineage(cor.match_corridors(logs(spark, sf_dir), segments(spark, sf_dir)).where("rank = 1"))
    starts = view(spark, sf_dir, "vertices").where("idx = 0").select("project_id", F.col("route_id").alias("point_id"), "lat", "lon")
    points = view(spark, sf_dir, "design_points").join(starts, ["project_id", "point_id"]).withColumn("role", tx.route_role(F.col("folder_path"), F.col("name")))
    return cut_lineage(cor.gate_routes(cor.gate_inputs(best, cor.anchor_points(best, points)), job.catalog))


@query("corridor_gate")
def corridor_gate(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "project_id", "source_file", "route_id", "anchored", "reject", "chain_seed", "role_preferred", "role_bonus", F.round("locality", 4).alias("locality"),
        "box_share", "end_inside", "penalty", "gate_ft")


@query("corridor_gate_counts")
def corridor_gate_counts(spark, sf_dir):
    return cor.gate_counts(gated(spark, sf_dir))


@query("corridor_route_pool")
def corridor_route_pool(spark, sf_dir):
    found = cor.filtered_pool(gated(spark, sf_dir), Job.of(spark, sf_dir).catalog)
    return found.withColumn("n_points", F.size("coords")).drop("coords")


@query("name_penalties", with_views("route_meta", then="""
SELECT project_id, route_id, CASE WHEN route_name IN ('Underground Cable', 'Backbone', 'Terminal Tail', 'Vacant Pipe', 'House Drop') THEN 220.0 ELSE 0.0 END + 120.0
  + CASE WHEN route_name LIKE 'House Drop%' THEN 0 ELSE 60.0 END AS penalty FROM route_meta"""))
def name_penalties(spark, sf_dir):
    from trenchline.functions import text as tx

    role = tx.route_role(F.col("source_folder"), F.col("route_name"))
    return view(spark, sf_dir, "route_meta").select("project_id", "route_id", cor.name_penalty(F.col("route_name"), F.col("source_folder"), role).alias("penalty"))
