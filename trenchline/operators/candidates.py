"""Which routes a run of log rows may lie on, and how well each fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import Matching
from trenchline.functions import geo
from trenchline.functions import text as tx
from trenchline.functions.stations import station_label
from trenchline.operators.grouping import GROUP


def sheet_hints(groups: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Sheets, streets and routes that the print tokens of each group name.

    `index` has one row per (project, token, street, route).  Groups explode to
    tokens and join on (project, token); Spark broadcasts the index when its size
    allows and shuffles on the key otherwise.
    """
    tokens = groups.select(*keys, F.explode("print_tokens").alias("token"))
    hints = (
        tokens.join(index, ["project_id", "token"])
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("sheet")).alias("sheets"),
             F.sort_array(F.collect_set("street")).alias("streets"),
             F.sort_array(F.collect_set("route_id")).alias("allowed_routes"))
    )
    empty = F.array().cast("array<string>")
    return groups.join(hints, keys, "left").withColumns({
        "sheets": F.coalesce("sheets", F.array().cast("array<int>")),
        "streets": F.coalesce("streets", empty),
        "allowed_routes": F.coalesce("allowed_routes", empty),
    })


def route_pool(groups: DataFrame, catalog: DataFrame, cfg: Matching = Matching(), spatial: DataFrame | None = None) -> DataFrame:
    """Plausible routes of each group.

    Groups whose print tokens name routes that exist meet only those, by an equi-join on
    (project, route); the others meet the routes of their project.  Routes under the length
    floor go unless none is left.  `spatial` (group box and centroid) is off by default.
    """
    routes = catalog.select("project_id", "route_id", "route_name", "source_folder", "route_role", "length_ft", "point_count", "catalog_rank")
    # what depends on the group alone is worked out before it meets its routes
    slim = groups.select(*GROUP, "source_file", "span_ft", "context", "sheets", "streets", "allowed_routes",
                         tx.expected_roles(F.col("context"), F.col("span_ft")).alias("expected_roles"), tx.name_words(F.col("source_file")).alias("_words"))
    named = slim.withColumn("route_id", F.explode("allowed_routes")).join(routes, ["project_id", "route_id"])
    named = named.withColumn("print_filtered", F.lit(True))
    hit = named.select(*GROUP).distinct()
    open_ = slim.join(hit, GROUP, "left_anti").join(routes, "project_id").withColumn("print_filtered", F.lit(False))
    pool = named.unionByName(open_)
    fits = (F.col("span_ft") <= 0) | (F.col("length_ft") <= 0) | (F.col("length_ft") >= F.col("span_ft") * cfg.min_length_ratio)
    pool = pool.withColumns({
        "fits": fits, "spatial_ok": F.lit(True), "spatial_hint": F.lit(0.0),
        "deferred": (F.col("span_ft") > 0) & (F.col("length_ft") > F.col("span_ft") * cfg.max_length_ratio)})
    if spatial is not None:
        pool = _with_spatial(pool, spatial, catalog)
    w = Window.partitionBy(*GROUP)
    keep = F.col("fits") & F.col("spatial_ok")
    pool = pool.withColumn("any_kept", F.max(keep.cast("int")).over(w) == 1).where(keep | ~F.col("any_kept"))
    hint = tx.name_hint(F.col("_words"), F.concat_ws(" ", "route_name", "source_folder"))
    return pool.withColumns({
        "name_hint": F.when(F.col("any_kept"), hint).otherwise(0.0),
        "spatial_hint": F.when(F.col("any_kept"), F.col("spatial_hint")).otherwise(0.0)}).drop("_words")


def _with_spatial(pool: DataFrame, spatial: DataFrame, catalog: DataFrame) -> DataFrame:
    """Buffered box overlap or a near centroid; groups without positions pass."""
    shape = catalog.select("project_id", "route_id", F.aggregate(
        "coords", F.struct(F.lit(90.0).alias("min_lat"), F.lit(-90.0).alias("max_lat"), F.lit(180.0).alias("min_lon"), F.lit(-180.0).alias("max_lon")),
        lambda a, p: F.struct(F.least(a["min_lat"], p["lat"]).alias("min_lat"), F.greatest(a["max_lat"], p["lat"]).alias("max_lat"),
                              F.least(a["min_lon"], p["lon"]).alias("min_lon"), F.greatest(a["max_lon"], p["lon"]).alias("max_lon"))).alias("route_box"),
        (F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lat"]) / F.size("coords")).alias("r_lat"),
        (F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["lon"]) / F.size("coords")).alias("r_lon"))
    near = pool.join(spatial.select(*GROUP, "box", "c_lat", "c_lon"), GROUP, "left").join(shape, ["project_id", "route_id"])
    lat_pad = F.greatest(F.lit(0.00042), (F.col("box.max_lat") - F.col("box.min_lat")) * 0.75)
    lon_pad = F.greatest(F.lit(0.00052), (F.col("box.max_lon") - F.col("box.min_lon")) * 0.75)
    away = geo.haversine_ft(F.col("r_lat"), F.col("r_lon"), F.col("c_lat"), F.col("c_lon"))
    touch = geo.boxes_touch(F.col("box"), F.col("route_box"), lat_pad, lon_pad)
    return near.withColumns({
        "spatial_ok": touch | F.coalesce(away <= 700.0, F.lit(False)),
        "spatial_hint": F.coalesce(F.greatest(F.lit(0.0), 1 - away / 900.0) * 0.18, F.lit(0.0)),
    }).drop("box", "c_lat", "c_lon", "route_box", "r_lat", "r_lon")


def score_pool(pool: DataFrame) -> DataFrame:
    """Candidate score of every pooled route, with its parts.

    Length fit leads; print, role, name, position and family closeness add; oversize costs.
    """
    span, length = F.col("span_ft"), F.col("length_ft")
    both = (span > 0) & (length > 0)
    ratio = F.when(both, F.least(span, length) / F.greatest(span, length)).otherwise(0.0)
    over = F.when(both & (length > span), length / F.greatest(span, F.lit(1.0))).otherwise(0.0)
    gap = F.abs(length - span)
    fit = F.greatest(F.lit(0.0), F.pow(ratio, F.lit(2.35)) - F.least(F.lit(0.42), F.greatest(F.lit(0.0), (over - 1.0) * 0.18)))
    base = F.round(F.least(F.lit(1.0), F.when(both, fit).otherwise(0.0)
                           + tx.role_bonus(F.col("route_role"), F.col("expected_roles"))
                           + F.when(F.col("point_count") >= 3, 0.02).otherwise(0.0)), 6)
    family = Window.partitionBy(*GROUP, F.lower(F.trim("route_name")), F.lower(F.trim("route_role")))
    staged = pool.withColumns({"ratio": ratio, "length_gap_ft": F.round(gap, 2), "base_score": base}).withColumns({
        "family_size": F.count("*").over(family), "best_gap": F.min(gap).over(family), "best_hint": F.max("spatial_hint").over(family),
        "short_ft": F.min("length_ft").over(family), "long_ft": F.max("length_ft").over(family)})
    many = F.col("family_size") > 1
    single = (F.size("allowed_routes") == 1) & F.array_contains("allowed_routes", F.col("route_id"))
    family_bonus = F.round(
        F.when(single, 0.14).otherwise(0.0)
        + F.when(many, F.greatest(F.lit(0.0), 1 - (gap - F.col("best_gap")) / F.greatest(F.lit(60.0), span * 0.20)) * 0.10).otherwise(0.0)
        + F.when(many & (F.col("best_hint") > 0), F.least("spatial_hint", "best_hint") / F.col("best_hint") * 0.05).otherwise(0.0)
        + F.when(many & (F.col("long_ft") > F.col("short_ft")) & (span > 0), F.col("ratio") * 0.04).otherwise(0.0), 6)
    parts = staged.withColumns({
        "print_bonus": F.when(F.col("print_filtered"), 0.10).otherwise(0.0),
        "subsection": F.col("ratio") * 0.08,
        "exact_length": F.when(both, F.greatest(F.lit(0.0), 1 - gap / F.greatest(span, F.lit(1.0))) * 0.16).otherwise(0.0),
        "oversize": F.least(F.lit(0.30), F.greatest(F.lit(0.0), (over - 1.15) * 0.10)),
        "role_score": F.when(F.col("route_role").isin("underground_cable", "backbone", "terminal_tail"), 0.04).otherwise(0.0),
        "family_bonus": family_bonus})
    total = (F.col("base_score") + F.col("print_bonus") + F.col("subsection") + F.col("exact_length") + F.col("role_score")
             + F.col("name_hint") + F.col("spatial_hint") + F.col("family_bonus") - F.col("oversize"))
    return parts.withColumn("score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6)).drop("expected_roles")


def rank_pool(scored: DataFrame, keep: int = Matching().keep_ranked) -> DataFrame:
    """Best routes of each group, with the lead of each over the next."""
    order = [F.desc("score"), F.asc("length_gap_ft"), F.asc("length_ft"), F.asc("route_name"), F.asc("route_id")]
    w = Window.partitionBy(*GROUP).orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return ranked.withColumn("next_score", F.lead("score").over(w))


def ranking_confidence(score: Column, next_score: Column) -> Column:
    """MEDIUM when the best route scores well and leads clearly, else LOW."""
    lead = F.round(score - F.coalesce(next_score, F.lit(0.0)), 6)
    clear = ((score >= 0.90) & (lead >= 0.14)) | ((score >= 0.78) & (lead >= 0.07))
    return F.when(clear, "MEDIUM").otherwise("LOW")


def _simple_score(bore: Column, overlap: Column, route: Column, named: Column) -> Column:
    """Overlap share x 60, length likeness x 30, 10 for a named route."""
    return (F.when(bore > 0, F.greatest(F.lit(0.0), overlap) / bore * 60).otherwise(0.0)
            + F.when(route > 0, F.greatest(F.lit(0.0), 30 - F.abs(route - bore) / route * 30)).otherwise(0.0)
            + F.when(named, 10.0).otherwise(0.0))


def length_bins(classes: DataFrame) -> DataFrame:
    """One row per project: its bins of routes of about one length, each with its ranges and one of its routes.

    Bins are quarters of a doubling, so a project has a few dozen however many routes it has.
    """
    ranges = (F.min("start_station").alias("start_lo"), F.max("end_station").alias("end_hi"), F.min("feet").alias("lo"), F.max("feet").alias("hi"),
              F.max("named").alias("any_named"), F.min(F.struct("start_station", "end_station", "named")).alias("one"))
    bins = classes.groupBy("project_id", "bin").agg(*ranges)
    return bins.groupBy("project_id").agg(F.collect_list(F.struct("bin", "start_lo", "end_hi", "lo", "hi", "any_named", "one")).alias("bins"))


def simple_match(logs: DataFrame, routes: DataFrame) -> DataFrame:
    """Simple matcher: the route of best score for each log; under 40 is refused.

    Routes of one range are one class, named by its smallest id, and classes stand in bins by
    length.  A bin's ranges bound the score of its routes from above, one route of each bin
    bounds the best from below; a log meets only the bins that can still hold its best route.
    """
    feet = F.col("end_station") - F.col("start_station")
    shape = ["project_id", "start_station", "end_station", "named"]
    classes = routes.withColumn("named", F.coalesce(F.col("route_name") != "", F.lit(False))).groupBy(*shape).agg(F.min("route_id").alias("route_id"))
    classes = classes.withColumn("feet", feet).withColumn("bin", F.when(feet > 0, F.floor(F.log2(feet) * 4)).otherwise(-1000).cast("int"))
    bore = F.col("end_ft") - F.col("start_ft")

    def score(start: Column, end: Column, route: Column, named: Column) -> Column:
        return _simple_score(bore, F.least(F.col("end_ft"), end) - F.greatest(F.col("start_ft"), start), route, named)

    def most(b: Column) -> Column:
        return score(b["start_lo"], b["end_hi"], F.greatest(b["lo"], F.least(bore, b["hi"])), b["any_named"])

    def certain(b: Column) -> Column:
        one = b["one"]
        return score(one["start_station"], one["end_station"], one["end_station"] - one["start_station"], one["named"])

    keys = ["project_id", "source_file"]
    asked = logs.join(length_bins(classes), "project_id").withColumn("floor", F.array_max(F.transform("bins", certain)))
    open_ = asked.withColumn("bin", F.explode(F.transform(F.filter("bins", lambda b: most(b) + 1e-5 >= F.col("floor")), lambda b: b["bin"]))).drop("bins", "floor")
    met = open_.join(classes, ["project_id", "bin"]).withColumn("score", score(F.col("start_station"), F.col("end_station"), F.col("feet"), F.col("named")))
    best = F.min_by(F.struct("route_id", "score", "end_station"), F.struct((-F.round("score", 6)).alias("s"), F.col("route_id")))
    return (
        met.groupBy(*keys, "start_ft", "end_ft").agg(best.alias("b"))
        .select(*keys, "start_ft", "end_ft", "b.route_id", F.col("b.score").alias("score"), "b.end_station")
        .withColumn("status", F.when(F.col("score") < 40, "rejected").otherwise("matched"))
    )


def simple_redline(matches: DataFrame, polylines: DataFrame) -> DataFrame:
    """Matched logs cut out of their route: clamped range, whole-segment slice, labels."""
    lo, hi = F.least("start_ft", "end_station"), F.least("end_ft", "end_station")
    cut = matches.where(F.col("status") == "matched").withColumns({"from_ft": F.least(lo, hi), "to_ft": F.greatest(lo, hi)}).join(
        polylines, ["project_id", "route_id"])
    return cut.select(
        "project_id", "source_file", "route_id", "from_ft", "to_ft", station_label(F.col("from_ft")).alias("start_label"),
        station_label(F.col("to_ft")).alias("end_label"), (F.col("to_ft") - F.col("from_ft")).alias("length_ft"),
        geo.slice_whole(F.col("coords"), F.col("chain"), F.col("from_ft"), F.col("to_ft")).alias("coords"))


def length_fit(pairs: DataFrame) -> DataFrame:
    """Length-fit match of a route to a log: fit, coverage of the farthest station, suggestion bonus, label.

    Expects span_ft (null without stations), farthest_ft, length_ft and suggested.
    """
    fit = F.col("length_ft") / F.greatest("span_ft", F.lit(1.0))
    covers = F.col("length_ft") >= F.col("farthest_ft") - 1e-6
    start = 1 - F.least(F.lit(1.0), F.abs(1 - fit))
    covered = F.when(covers, F.least(F.lit(1.0), start + 0.15)).otherwise(F.greatest(F.lit(0.05), start - 0.35))
    scored = F.when(F.col("suggested"), F.least(F.lit(1.0), covered + 0.05)).otherwise(covered)
    conf = F.when(F.col("span_ft").isNull(), F.when(F.col("suggested"), 1.0).otherwise(0.45)).otherwise(scored)
    staged = pairs.withColumns({"length_fit": F.round(fit, 4), "covers": F.coalesce(covers, F.lit(True)), "confidence": F.round(conf, 4),
                                "length_delta_ft": F.round(F.round(F.abs(F.col("length_ft") - F.col("span_ft")), 6), 1)})
    label = (F.when(F.col("span_ft").isNull(), "No station span yet")
             .when((F.col("confidence") >= 0.8) & F.col("covers") & F.col("length_fit").between(0.75, 1.08), "Strong match")
             .when((F.col("confidence") >= 0.55) & F.col("covers") & F.col("length_fit").between(0.55, 1.25), "Possible match")
             .when(~F.col("covers"), "Low confidence").otherwise("Review needed"))
    return staged.withColumn("confidence_label", label)


def recommend(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Label and reasons of every matched route of a log.  Expects confidence, covers,
    length_delta_ft, route_role and penalty (extra-turn measure)."""
    w = Window.partitionBy(*keys)
    top = F.max("confidence").over(w)
    top_route = F.min_by("route_id", F.struct((-F.col("confidence")).alias("c"), F.col("route_id"))).over(w)
    conf = F.col("confidence")
    label = (F.when((F.col("route_id") == top_route) & (conf >= 0.90) & F.col("covers"), "Recommended")
             .when(conf >= F.greatest(F.lit(0.75), F.round(top - 0.08, 6)), "Alternative")
             .when(conf >= 0.55, "Review option").otherwise("Low-confidence option"))
    reasons = F.array_compact(F.array(
        F.when(F.col("covers"), "covers the farthest station").otherwise("shorter than the farthest station"),
        F.when(F.col("length_delta_ft") <= 50, "very tight length").when(F.col("length_delta_ft") <= 150, "good length")
        .when(F.col("length_delta_ft").isNotNull(), "weak length"),
        F.when(F.col("route_role").isin("underground_cable", "backbone", "vacant_pipe", "terminal_tail"), "drill-path role").otherwise("other role"),
        F.when(F.col("penalty") <= 0.5, "simple geometry").when(F.col("penalty") <= 1.5, "few extra turns").otherwise("many extra turns")))
    return matches.withColumns({"label": label, "reasons": reasons})


def file_assignments(logs: DataFrame, choices: DataFrame, catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """Chosen route of each file with its name and match filled in; a file without a choice stays open."""
    names = catalog.select("project_id", "route_id", F.col("route_name").alias("catalog_name"))
    picked = logs.join(choices, ["project_id", "source_file"], "left").join(names, ["project_id", "route_id"], "left")
    found = matches.select("project_id", "source_file", "route_id", F.col("confidence_label").alias("matched_label"))
    return picked.join(found, ["project_id", "source_file", "route_id"], "left").select(
        "project_id", "source_file", "route_id",
        F.coalesce(F.nullif(F.trim("route_name"), F.lit("")), "catalog_name", "route_id").alias("route_name"),
        F.when(F.col("route_id").isNull(), None).otherwise(F.coalesce("matched_label", F.lit("Manual assignment"))).alias("match_label"))


def file_runs(points: DataFrame) -> DataFrame:
    """Completed trace of each file on its route: first and last place, usable when both
    differ by a foot along the route and on the ground.  Expects located distinct stations."""
    keys = ["project_id", "source_file", "route_id"]
    first = F.min_by(F.struct("station", "at_ft", "lat", "lon", "depth_ft", "boc_ft", "date", "crew", "print"), F.struct("station_ft", "station"))
    last = F.max_by(F.struct("station", "at_ft", "lat", "lon"), F.struct("station_ft", "station"))
    runs = points.groupBy(*keys).agg(first.alias("a"), last.alias("z"), F.count("*").alias("n_points"))
    apart = geo.haversine_ft(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"))
    return runs.withColumn("usable", (F.col("n_points") >= 2) & (F.abs(F.col("z.at_ft") - F.col("a.at_ft")) >= 1) & (apart >= 1))
