"""Queries over as-built output: coverage, billing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import candidates as cand
from trenchline.operators import coverage as cov
from trenchline.operators import quality, reports, routes
from trenchline.plans.check_sql import RAW, ROUTES, sql
from trenchline.plans.inputs import cte, view, with_views
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_geometry import catalog, r, raw_chain
from trenchline.plans.queries_matching import GROUP_FOLD, match_sql
from trenchline.plans.queries_quality import clean_rows
from trenchline.plans.queries_text import feet_sql
from trenchline.plans.registry import query
from trenchline.sources import design

KEY = routes.KEY


def log_stretches(spark, sf_dir):
    """Each log laid on its own route from the first station on; stretches between rows of a group."""
    rows = quality.relative_progress(Job.of(spark, sf_dir).grouped_rows, ["project_id", "source_file"]).withColumn(
        "route_id", F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1)))
    pairs = quality.pair_spans(rows.select(*KEY, "group_id", "at_ft"), [*KEY, "group_id"], "at_ft", "at_ft")
    return pairs.where(F.col("reject_reason").isNull()).select(*KEY, "start_ft", "end_ft")


_STRETCH = [*GROUP_FOLD, """rl AS (SELECT *, ft - min(ft) OVER (PARTITION BY project_id, source_file) AS rel_ft FROM fold)""",
            """st AS (SELECT project_id, concat('route_', split_part(source_file, '_', 3)) AS route_id, rel_ft AS start_ft, nx AS end_ft FROM
  (SELECT *, lead(rel_ft) OVER (PARTITION BY project_id, source_file, tokens_key, gid ORDER BY rel_ft) AS nx FROM rl) WHERE nx IS NOT NULL AND nx <> rel_ft)"""]


def _union(src: str, tol: float) -> str:
    return f"""mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY project_id, route_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {tol} THEN 0 ELSE 1 END AS new
  FROM (SELECT project_id, route_id, least(start_ft, end_ft) AS s, greatest(start_ft, end_ft) AS e FROM {src}) WHERE e > s),
un AS (SELECT project_id, route_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY project_id, route_id ORDER BY s, e) AS part FROM mk) GROUP BY project_id, route_id, part)"""


@query("coverage_billing", match_sql(*RAW, *_STRETCH, _union("st", 5), then="""
, tot AS (SELECT project_id, route_id, round(max(end_ft), 2) AS length_ft FROM seg GROUP BY 1, 2),
cv AS (SELECT project_id, route_id, round(sum(e - s), 2) AS unique_length_ft, count(*) AS merged_count FROM un GROUP BY 1, 2)
SELECT project_id, route_id, length_ft, coalesce(merged_count, 0) AS merged_count, coalesce(unique_length_ft, 0) AS unique_length_ft,
  round(round(coalesce(unique_length_ft, 0) / length_ft * 100, 8), 2) AS completion_pct, CAST(round(coalesce(unique_length_ft, 0) * 3.5, 2) AS DECIMAL(18,2)) AS material_total,
  CAST(round(coalesce(unique_length_ft, 0) * 1.5, 2) AS DECIMAL(18,2)) AS splicing_total, CAST(round(coalesce(unique_length_ft, 0) * 5.0, 2) AS DECIMAL(18,2)) AS grand_total
FROM tot LEFT JOIN cv USING (project_id, route_id)"""))
def coverage_billing(spark, sf_dir):
    lengths = raw_chain(spark, sf_dir).groupBy(*KEY).agg(F.round(F.max("chain_ft"), 2).alias("length_ft"))
    covered = cov.coverage(log_stretches(spark, sf_dir)).select(*KEY, "merged_count", "unique_length_ft")
    feet = F.coalesce("unique_length_ft", F.lit(0.0))
    return lengths.join(covered, KEY, "left").select(
        *KEY, "length_ft", F.coalesce("merged_count", F.lit(0)).alias("merged_count"), feet.alias("unique_length_ft"),
        F.round(F.round(feet / F.col("length_ft") * 100, 8), 2).alias("completion_pct"), *cov.billing(feet))


@query("interval_union", with_views("built", then=", " + _union("built", 0.01) + "\nSELECT project_id, route_id, s AS start_ft, e AS end_ft, e - s AS length_ft FROM un"))
def interval_union(spark, sf_dir):
    return cov.merge_intervals(view(spark, sf_dir, "built"), KEY)


@query("route_coverage", with_views("built", then=", " + _union("built", 5.0) + """
, rawc AS (SELECT project_id, route_id, count(*) AS n, sum(abs(end_ft - start_ft)) AS r FROM built WHERE end_ft <> start_ft GROUP BY 1, 2), u AS (SELECT project_id, route_id, count(*) AS m, sum(e - s) AS u FROM un GROUP BY 1, 2)
SELECT project_id, route_id, n AS interval_count, m AS merged_count, round(r, 2) AS raw_length_ft, round(u, 2) AS unique_length_ft, round(greatest(0, round(r, 2) - round(u, 2)), 2) AS overlap_removed_ft FROM rawc JOIN u USING (project_id, route_id)"""))
def route_coverage(spark, sf_dir):
    return cov.coverage(view(spark, sf_dir, "built")).drop("merged")


_ACTIVE = """chosen AS (SELECT project_id, CASE WHEN no % 2 = 0 THEN concat(' route_', no * 10 + 3, ' ') ELSE 'none' END AS route_id
  FROM (SELECT DISTINCT project_id, CAST(substr(project_id, 2) AS BIGINT) AS no FROM catalog_)),
active AS (SELECT project_id, arg_min(c.route_id, (c.route_id <> coalesce(trim(h.route_id), ''), catalog_rank)) AS route_id FROM catalog_ c LEFT JOIN chosen h USING (project_id) GROUP BY 1)"""


def _active(spark, sf_dir):
    lines = catalog(spark, sf_dir)
    no = F.substring("project_id", 2, 20).cast("long")
    chosen = lines.select("project_id").distinct().withColumn(
        "route_id", F.when(no % 2 == 0, F.concat(F.lit(" route_"), (no * 10 + 3).cast("string"), F.lit(" "))).otherwise("none"))
    return routes.active_routes(lines, chosen)


@query("active_routes", sql(*ROUTES, _ACTIVE, then="SELECT project_id, route_id, route_name, length_ft, point_count FROM active JOIN catalog_ USING (project_id, route_id)"))
def active_routes(spark, sf_dir):
    return _active(spark, sf_dir).select("project_id", "route_id", "route_name", "length_ft", F.size("coords").alias("point_count"))


@query("active_route_coverage", sql(*ROUTES, cte("built"), _ACTIVE, _union("built", 5.0), then="""
, cv AS (SELECT project_id, route_id, count(*) AS m, round(sum(e - s), 2) AS u FROM un GROUP BY 1, 2)
SELECT project_id, route_id, length_ft, coalesce(m, 0) AS merged_count, coalesce(u, 0) AS unique_length_ft, round(round(coalesce(u, 0) / length_ft * 100, 8), 2) AS completion_pct
FROM active JOIN catalog_ USING (project_id, route_id) LEFT JOIN cv USING (project_id, route_id)"""))
def active_route_coverage(spark, sf_dir):
    return cov.active_coverage(view(spark, sf_dir, "built"), _active(spark, sf_dir))


@query("project_coverage", sql(*ROUTES, cte("built"), _union("built", 5.0), then="""
, rawc AS (SELECT project_id, route_id, count(*) AS n, round(sum(abs(end_ft - start_ft)), 2) AS r FROM built WHERE end_ft <> start_ft GROUP BY 1, 2), u AS (SELECT project_id, route_id, count(*) AS m, round(sum(e - s), 2) AS u FROM un GROUP BY 1, 2),
p AS (SELECT project_id, sum(n) AS n, sum(m) AS m, round(sum(r), 2) AS r, round(sum(u), 2) AS u, sum(length_ft) AS d FROM rawc JOIN u USING (project_id, route_id) JOIN catalog_ USING (project_id, route_id) GROUP BY 1),
al AS (SELECT project_id, sum(length_ft) AS d0 FROM catalog_ GROUP BY 1)
SELECT project_id, CAST(coalesce(n, 0) AS BIGINT) AS interval_count, CAST(coalesce(m, 0) AS BIGINT) AS merged_count, coalesce(r, 0) AS raw_length_ft, coalesce(u, 0) AS covered_ft, round(greatest(0, coalesce(r, 0) - coalesce(u, 0)), 2) AS overlap_removed_ft,
  round(coalesce(d, d0), 2) AS design_ft, round(round(coalesce(u, 0) / coalesce(d, d0) * 100, 8), 2) AS completion_pct, CAST(round(coalesce(u, 0) * 3.5, 2) AS DECIMAL(18,2)) AS material_total,
  CAST(round(coalesce(u, 0) * 1.5, 2) AS DECIMAL(18,2)) AS splicing_total, CAST(round(coalesce(u, 0) * 5.0, 2) AS DECIMAL(18,2)) AS grand_total FROM al LEFT JOIN p USING (project_id)"""))
def project_coverage(spark, sf_dir):
    return cov.coverage_totals(cov.coverage(view(spark, sf_dir, "built")), catalog(spark, sf_dir))


@query("design_lengths", sql(*ROUTES, then="SELECT project_id, round(sum(length_ft), 2) AS design_ft FROM catalog_ GROUP BY 1"))
def design_lengths(spark, sf_dir):
    return cov.design_length(catalog(spark, sf_dir))


@query("deduplicated_stretches")
def deduplicated_stretches(spark, sf_dir):
    return cov.deduplicate(view(spark, sf_dir, "built"))


_NEXT = """nx AS (SELECT *, lead(start_ft) OVER w AS s2, lead(end_ft) OVER w AS e2 FROM (SELECT DISTINCT project_id, route_id, source_file, crew, date, start_ft, end_ft FROM built) WINDOW w AS (PARTITION BY project_id, route_id, source_file, crew, date ORDER BY start_ft, end_ft)),
ov AS (SELECT *, greatest(0, least(end_ft, e2) - greatest(start_ft, s2)) AS o, greatest(0, least(end_ft, e2) - greatest(start_ft, s2)) / greatest(least(end_ft - start_ft, e2 - s2), 1e-9) AS ratio FROM nx WHERE s2 IS NOT NULL)"""


@query("overlap_classes", with_views("built", then=f""", {_NEXT}
SELECT project_id, route_id, source_file, crew, date, s2 AS start_ft, e2 AS end_ft, round(o, 2) AS overlap_ft, CASE WHEN ratio > 0.85 THEN 'drop_duplicate' WHEN ratio > 0.5 THEN 'trim_partial' WHEN o > 0 THEN 'minor_overlap_keep' ELSE 'no_overlap' END AS overlap_class,
  CASE WHEN o <= 0 THEN e2 - s2 ELSE CASE WHEN s2 < start_ft AND least(e2, start_ft) - s2 > 0.01 THEN least(e2, start_ft) - s2 ELSE 0 END + CASE WHEN e2 > end_ft AND e2 - greatest(s2, end_ft) > 0.01 THEN e2 - greatest(s2, end_ft) ELSE 0 END END AS remaining_ft FROM ov"""))
def overlap_classes(spark, sf_dir):
    """Each stretch against the one before it of the same source."""
    from trenchline.operators.ownership import overlap_ft
    from trenchline.operators.sequences import split_blocks, with_neighbours

    keys = [*KEY, "source_file", "crew", "date"]
    once = view(spark, sf_dir, "built").select(*keys, "start_ft", "end_ft").distinct()
    near = with_neighbours(split_blocks(once, keys, F.floor(F.col("start_ft") / cov.BLOCK_FT)), keys, ["start_ft", "end_ft"], ["start_ft", "end_ft"])
    pair = near.where("prev IS NOT NULL").withColumn("o", overlap_ft(F.col("start_ft"), F.col("end_ft"), F.col("prev.start_ft"), F.col("prev.end_ft")))
    piece, taken = F.struct(F.col("start_ft").alias("s"), F.col("end_ft").alias("e")), F.struct(F.col("prev.start_ft").alias("s"), F.col("prev.end_ft").alias("e"))
    left = F.aggregate(cov.subtract(piece, taken), F.lit(0.0), lambda a, p: a + p["e"] - p["s"])
    return pair.select(
        *keys, "start_ft", "end_ft", F.round("o", 2).alias("overlap_ft"),
        cov.overlap_class(F.lit(True), F.col("o"), F.col("end_ft") - F.col("start_ft"), F.col("prev.end_ft") - F.col("prev.start_ft")).alias("overlap_class"),
        F.when(F.col("o") <= 0, F.col("end_ft") - F.col("start_ft")).otherwise(left).alias("remaining_ft"))


@query("drill_path_runs", with_views("built", then="""
, o AS (SELECT *, 'p' || CAST(date AS VARCHAR) AS print, CAST(row_key AS VARCHAR) AS g FROM built),
k AS (SELECT *, CASE WHEN lag(route_id) OVER w = route_id AND lag(print) OVER w = print AND lag(source_file) OVER w = source_file THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY project_id ORDER BY source_file, print, g, row_key)),
n AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY source_file, print, g, row_key) AS run FROM k)
SELECT project_id, route_id, print, source_file, round(sum(end_ft - start_ft), 2) AS length_ft, round(sum(end_ft - start_ft) * 5, 2) AS cost, count(*) AS n_segments, arg_min(row_key, (g, row_key)) AS start_station, arg_max(row_key, (g, row_key)) AS end_station
FROM n GROUP BY project_id, run, route_id, print, source_file"""))
def drill_path_runs(spark, sf_dir):
    built = view(spark, sf_dir, "built").withColumns({
        "print": F.concat(F.lit("p"), "date"), "group_id": F.col("row_key").cast("string"), "row_index": F.col("row_key"), "length_ft": F.col("end_ft") - F.col("start_ft"),
        "start_station": F.col("row_key"), "end_station": F.col("row_key")})
    return cov.drill_runs(built, 5.0)


@query("manual_billing", with_views("built", then="""
, p AS (SELECT project_id, sum(end_ft - start_ft) AS f FROM built GROUP BY 1), m AS (SELECT project_id, CASE WHEN CAST(substr(project_id, 2) AS BIGINT) % 3 = 0 THEN 1000.0 ELSE f END AS feet FROM p),
x AS (SELECT project_id, sum(CAST(row_key % 10 AS DOUBLE)) AS ex FROM built GROUP BY 1)
SELECT project_id, round(feet, 2) AS footage_ft, round(round(feet * 4.25, 6), 2) AS base_total, round(round(feet * 4.25 + ex, 6), 2) AS final_total FROM m JOIN x USING (project_id)"""))
def manual_billing(spark, sf_dir):
    built = view(spark, sf_dir, "built").withColumn("length_ft", F.col("end_ft") - F.col("start_ft"))
    projects = built.select("project_id").distinct()
    manual = projects.select("project_id", F.lit(4.25).alias("rate"), F.when(F.substring("project_id", 2, 20).cast("long") % 3 == 0, 1000.0).alias("manual_ft"))
    covered = projects.withColumn("covered_ft", F.lit(0.0))
    return cov.manual_billing(built, covered, manual, built.select("project_id", (F.col("row_key") % 10).cast("double").alias("amount")))


def _runs(spark, sf_dir):
    rows = quality.relative_progress(clean_rows(spark, sf_dir), ["project_id", "source_file"]).withColumn("route_id", F.concat(F.lit("route_"), F.element_at(F.split("source_file", "_"), -1)))
    keys = ["project_id", "source_file", "route_id", "station"]
    rest = ["station_ft", "depth_ft", "boc_ft", "date", "crew", "print", "notes", "at_ft"]
    once = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("print")).alias("x")).select(*keys, "x.*")
    return routes.locate(once, routes.route_segments(raw_chain(spark, sf_dir)))


_PROD = [cte("bore_rows"), f"""fr AS (SELECT *, {feet_sql('station')} AS ft, concat('route_', split_part(source_file, '_', 3)) AS route_id FROM bore_rows),
fo AS (SELECT project_id, source_file, route_id, station, ft, arg_min(depth_ft, print) AS depth_ft, arg_min(boc_ft, print) AS boc_ft, arg_min(crew, print) AS crew, arg_min(notes, print) AS notes, min(print) AS print FROM fr GROUP BY 1, 2, 3, 4, 5),
pr AS (SELECT project_id, source_file, route_id, arg_min(station, ft) AS start_station, arg_max(station, ft) AS end_station, round(max(ft) - min(ft), 2) AS length_ft, arg_min(depth_ft, ft) AS depth_ft, arg_min(boc_ft, ft) AS boc_ft,
  '' AS date, arg_min(crew, ft) AS crew, arg_min(print, ft) AS print, CASE WHEN bool_or(notes <> '') THEN 'hard rock' ELSE '' END AS notes FROM fo GROUP BY 1, 2, 3 HAVING max(ft) - min(ft) >= 1)"""]


@query("production_report", "WITH " + ", ".join(_PROD) + " SELECT * FROM pr")
def production_report(spark, sf_dir):
    points = _runs(spark, sf_dir)
    return reports.production_rows(cand.file_runs(points), points)


@query("crew_summary", "WITH " + ", ".join(_PROD) + """ SELECT CASE WHEN crew = 'A' THEN 'A' ELSE 'Unknown' END AS crew, count(DISTINCT source_file) AS bore_logs, count(DISTINCT route_id) AS routes, count(*) AS segments,
  round(sum(length_ft), 2) AS total_length_ft, round(sum(length_ft) * 3.5, 2) AS total_cost FROM pr GROUP BY 1""")
def crew_summary(spark, sf_dir):
    points = _runs(spark, sf_dir)
    rows = reports.production_rows(cand.file_runs(points), points).withColumns({"crew": F.when(F.col("crew") == "A", "A").otherwise(" "), "route_name": F.col("route_id")})
    return reports.crew_summary(rows, 3.5)


@query("markup_records", """WITH d AS (SELECT doc_id, ['route_gap', 'deviation', 'handhole_change', 'paint'][CAST(doc_id % 4 AS INT) + 1] AS issue_type, ['point', 'cloud', 'circle'][CAST(doc_id % 3 AS INT) + 1] AS geometry_type, n_chars FROM documents)
SELECT concat('m', doc_id) AS record_id, issue_type, geometry_type, CASE WHEN doc_id % 5 = 0 THEN 'alert' ELSE 'review' END AS severity, CASE WHEN issue_type = 'paint' THEN 'bad issue_type' WHEN geometry_type = 'circle' THEN 'bad geometry_type'
  WHEN doc_id % 7 = 0 THEN 'bad points' END AS reject_reason FROM d""")
def markup_records(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")

    def one_of(*values):
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))

    raw = docs.select(
        F.concat(F.lit("m"), "doc_id").alias("record_id"), F.col("doc_id").cast("string").alias("sheet_number"), F.lit("moved").alias("note_text"),
        one_of("route_gap", "deviation", "handhole_change", "paint").alias("issue_type"), one_of("point", "cloud", "circle").alias("geometry_type"),
        F.when(F.col("doc_id") % 5 == 0, "alert").alias("severity"),
        F.array(F.struct(F.lit(1.0).alias("x"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("y"))).alias("points"))
    return reports.markup_records(raw).select("record_id", "issue_type", "geometry_type", "severity", "reject_reason")


@query("asbuilt_points")
def asbuilt_points(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return job.station_points.select(*KEY, "group_id", "source_file", "pos", "point_role", "station", "mapped_ft", r("lat", 7), r("lon", 7))


@query("asbuilt_segments")
def asbuilt_segments(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return cov.with_geometry(job.built, job.catalog).select(*KEY, "group_id", "source_file", "row_index", "start_station", "end_station", "start_ft", "end_ft", "length_ft", F.size("coords").alias("n_points"))


@query("asbuilt_coverage")
def asbuilt_coverage(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return cov.coverage_totals(cov.coverage(job.built), job.catalog)


@query("batch_summary")
def batch_summary(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return reports.batch_summary(job.selected, job.owned)


@query("selected_match")
def selected_match(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return reports.selected_match(job.selected, job.owned, job.groups)


@query("group_payload")
def group_payload(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return reports.group_payload(job.groups, job.selected, job.owned, job.ranked)


@query("match_debug")
def match_debug(spark, sf_dir):
    job = Job.of(spark, sf_dir)
    return reports.match_debug(job.groups, job.ranked, job.evaluated)


@query("map_export", with_views("route_meta", "bore_rows", then=f"""
, b AS (SELECT project_id, CASE WHEN route_name LIKE 'House Drop%' THEN 2 ELSE 1 END AS section, count(*) AS n FROM route_meta GROUP BY 1, 2 UNION ALL SELECT project_id, 4, count(*) FROM bore_rows GROUP BY 1 UNION ALL SELECT project_id, 3, count(*) FROM route_meta GROUP BY 1)
SELECT project_id, section, CAST(n + 2 AS BIGINT) AS n_lines FROM b UNION ALL SELECT DISTINCT project_id, -1, 1 FROM route_meta UNION ALL SELECT DISTINCT project_id, 9, 1 FROM route_meta"""))
def map_export(spark, sf_dir):
    lines = routes.as_polylines(raw_chain(spark, sf_dir)).join(view(spark, sf_dir, "route_meta"), KEY)
    features = lines.select("project_id", F.lit("line").alias("kind"), F.when(F.startswith("route_name", F.lit("House Drop")), "house_drop").otherwise("x").alias("role"),
                            F.col("route_name").alias("name"), F.col("doc_pos").cast("long").alias("feature_pos"), "coords")
    runs = lines.select("project_id", F.col("doc_pos").cast("long").alias("run_no"), F.col("route_id").alias("name"), "coords", F.lit("5 ft deep").alias("description"))
    rows = clean_rows(spark, sf_dir)
    stations = rows.select("project_id", F.xxhash64("source_file", "print", "station").alias("station_no"), "station", F.lit(30.16).alias("lat"), F.lit(-96.4).alias("lon"),
                           F.concat_ws(" ", "crew", "notes").alias("description"))
    return design.export_lines(features, runs, stations).groupBy("project_id", "section").agg(F.count("*").alias("n_lines"))
