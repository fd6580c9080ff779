"""Report tables: project names, production runs, crew totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_names(features: DataFrame, logs: DataFrame) -> DataFrame:
    """First polygon name, else first line folder, else the latest log file, else `--`."""
    named = features.groupBy("project_id").agg(
        F.min_by(F.when((F.col("kind") == "polygon") & (F.col("name") != ""), F.col("name")),
                 F.when((F.col("kind") == "polygon") & (F.col("name") != ""), F.col("feature_pos"))).alias("polygon"),
        F.min_by(F.when((F.col("kind") == "line") & (F.col("folder_path") != ""), F.col("folder_path")),
                 F.when((F.col("kind") == "line") & (F.col("folder_path") != ""), F.col("feature_pos"))).alias("folder"))
    latest = logs.groupBy("project_id").agg(F.max("source_file").alias("latest"))
    return named.join(latest, "project_id", "full").select(
        "project_id", F.coalesce("polygon", "folder", "latest", F.lit("--")).alias("project_name"))


def production_rows(runs: DataFrame, points: DataFrame) -> DataFrame:
    """One row per usable file run: ends, length, first-row attributes and distinct notes in order."""
    keys = ["project_id", "source_file", "route_id"]
    first_seen = points.where(F.col("notes") != "").groupBy(*keys, "notes").agg(F.min("station_ft").alias("at"))
    notes = first_seen.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "notes"))), lambda n: n["notes"]), " | ").alias("notes"))
    return runs.where("usable").join(notes, keys, "left").select(
        *keys, F.col("a.station").alias("start_station"), F.col("z.station").alias("end_station"), F.round(F.abs(F.col("z.at_ft") - F.col("a.at_ft")), 2).alias("length_ft"),
        F.col("a.depth_ft").alias("depth_ft"), F.col("a.boc_ft").alias("boc_ft"), F.col("a.date").alias("date"), F.col("a.crew").alias("crew"),
        F.col("a.print").alias("print"), F.coalesce("notes", F.lit("")).alias("notes"))


def crew_summary(production: DataFrame, material_rate: float) -> DataFrame:
    """Logs, routes, segments, feet and cost per crew; blank crews count as Unknown and come first."""
    def named(col: str, blank: str):
        return F.when(F.trim(F.coalesce(F.col(col), F.lit(""))) == "", blank).otherwise(F.trim(col))
    return (production.groupBy(named("crew", "Unknown").alias("crew")).agg(
        F.countDistinct(named("source_file", "field_file")).alias("bore_logs"), F.countDistinct(named("route_name", "Unassigned")).alias("routes"),
        F.count("*").alias("segments"), F.round(F.sum("length_ft"), 2).alias("total_length_ft"), F.round(F.sum("length_ft") * material_rate, 2).alias("total_cost"))
        .orderBy(F.col("crew") != "Unknown", "crew"))


def batch_summary(selected: DataFrame, owned: DataFrame) -> DataFrame:
    """Counts of a project's groups: matched routes, shown, blocked, warned, failed."""
    both = selected.select("project_id", "group_id", "status").join(
        owned.select("project_id", "group_id", F.col("route_id").alias("owned_route"), "accepted"), ["project_id", "group_id"])
    return both.groupBy("project_id").agg(
        F.count("*").alias("group_count"), F.countDistinct(F.when(F.col("accepted"), F.col("owned_route"))).alias("unique_matched_routes"),
        F.count_if("accepted").alias("rendered_group_count"), F.count_if(~F.col("accepted")).alias("blocked_group_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"), F.count_if(F.col("status") == "fail").alias("fail_count"))


def selected_match(selected: DataFrame, owned: DataFrame, groups: DataFrame) -> DataFrame:
    """The one match to show for projects whose shown groups all lie on one route."""
    shown = owned.where("accepted").join(groups.select("project_id", "group_id", "row_count"), ["project_id", "group_id"]).join(
        selected.select("project_id", "group_id", "committed"), ["project_id", "group_id"])
    order = F.struct((~F.col("committed")).alias("a"), (-F.col("row_count")).alias("b"), (-F.round("combined", 3)).alias("c"), F.col("group_id").alias("d"))
    return (shown.groupBy("project_id").agg(F.countDistinct("route_id").alias("n_routes"), F.min_by(F.struct("group_id", "route_id", "combined"), order).alias("m"))
            .where("n_routes = 1").select("project_id", "m.group_id", "m.route_id", F.round("m.combined", 3).alias("confidence")))


def group_payload(groups: DataFrame, selected: DataFrame, owned: DataFrame, ranked: DataFrame) -> DataFrame:
    """Compact row per group: range, match, verdict, reasons, and its three best routes."""
    best = ranked.where("rank <= 3").groupBy("project_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("rank", "route_id", "score", "length_gap_ft"))).alias("preview"))
    key = ["project_id", "group_id"]
    return (groups.select(*key, "source_file", F.array_join("print_tokens", ",").alias("print"), "row_count", "min_station_ft", "max_station_ft")
            .join(selected.select(*key, "status", "confidence_label", "consensus_route", "block_reasons", "review_reasons"), key, "left")
            .join(owned.select(*key, "route_id", "accepted", "reason"), key, "left").join(best, key, "left"))


def match_debug(groups: DataFrame, ranked: DataFrame, evaluated: DataFrame, keep: int = 8) -> DataFrame:
    """Wide debugging record per group: summary, ranked routes, evaluated hypotheses."""
    key = ["project_id", "group_id"]
    routes = ranked.where(F.col("rank") <= keep).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "route_id", "score", "base_score", "print_bonus", "subsection", "exact_length", "oversize", "role_score", "name_hint", "spatial_hint", "family_bonus"))).alias("candidate_routes"))
    tried = evaluated.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "eval_rank", "route_id", "start_ft", "end_ft", "window_score", "combined", "status", "billable", "reasons", "g_chain", "g_node"))).alias("hypotheses"))
    return groups.select(*key, "source_file", "print_tokens", "sheets", "row_count", "span_ft").join(routes, key, "left").join(tried, key, "left")


# Allowed values of a markup record.
MARKUP_ENUMS = {
    "issue_type": ("route_gap", "bore_offset", "deviation", "obstruction", "utility_conflict", "changed_bore_path", "new_conduit", "rod_and_rope",
                   "strand_change", "handhole_change", "splice_change", "panel_change", "other"),
    "geometry_type": ("point", "polyline", "polygon", "arrow", "cloud"),
    "severity": ("info", "review", "alert"),
    "source": ("foreman", "qa_engine", "bore_log", "kmz_compare"),
}
MARKUP_DEFAULTS = {"severity": "review", "source": "qa_engine", "color": "red", "stroke_width": 3, "verified_by_foreman": False}


def markup_records(raw: DataFrame) -> DataFrame:
    """As-built markup records with defaults filled and the first broken rule as reject reason."""
    filled = raw
    for name, value in MARKUP_DEFAULTS.items():
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in raw.columns else F.lit(value))
    reason = F.when(F.col("record_id").isNull(), "missing record_id").when(F.col("sheet_number").isNull(), "missing sheet_number").when(
        F.col("note_text").isNull(), "missing note_text")
    for name, allowed in MARKUP_ENUMS.items():
        reason = reason.when(~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), f"bad {name}")
    reason = reason.when(F.exists("points", lambda p: p["x"].isNull() | p["y"].isNull()), "bad points")
    return filled.withColumn("reject_reason", reason)
