"""Pass/fail checks of anchored hypotheses, the choice among them, and what may be shown.

A hypothesis is one row (group, route) carrying its projected stations as arrays, so the
checks are narrow column work; only the comparisons inside a group (at most three rows)
use a window, and neighbour links come from one join per route side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trenchline.config import ROLE_TRANSITIONS
from trenchline.functions import geo
from trenchline.functions.stations import let
from trenchline.operators.grouping import GROUP
from trenchline.session import cut_lineage

LINK_FT = 3.0
NEIGHBOURS = 10


def _verdict(*rules: tuple[Column, str, str], ok: str) -> Column:
    """First failing rule wins: struct(passed, reason, tag); tag goes to the billing reasons."""
    def of(passed: bool, reason: str, tag: str | None) -> Column:
        return F.struct(F.lit(passed).alias("passed"), F.lit(reason).alias("reason"), F.lit(tag).cast("string").alias("tag"))
    out = None
    for test, reason, tag in rules:
        hit = F.coalesce(test, F.lit(False))
        good = reason.startswith("+")
        value = of(good, reason.lstrip("+"), None if good else tag)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(of(True, ok, None))


def _steps(values: Column) -> Column:
    """Differences of consecutive values."""
    return F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), lambda v, i: v - F.get(values, i))


def _places(catalog: DataFrame, index: int) -> DataFrame:
    """The distinct places where routes start (index 0) or end (-1)."""
    return catalog.select("project_id", F.element_at("coords", 1 if index == 0 else -1).alias("p")).distinct()


def _routes_at(catalog: DataFrame, index: int) -> DataFrame:
    return catalog.select("project_id", "route_id", F.element_at("coords", 1 if index == 0 else -1).alias("p"))


def place_links(catalog: DataFrame) -> DataFrame:
    """Pairs (e, s): a place where routes end within 3 ft of a place where routes start.

    An equi-join of distinct places on grid cells whose width follows the latitude of their
    row; a start looks as far around as 3 ft reach at its own latitude.
    """
    y_deg = 1e-5
    reach = LINK_FT / geo.FEET_PER_DEG * 1.01

    def width(row: Column) -> Column:
        return F.lit(y_deg) / F.greatest(F.cos(F.radians(F.abs(row * y_deg))), F.lit(1e-3))

    def cells(low: Column, high: Column, step) -> Column:
        return F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))

    ends = _places(catalog, -1).withColumnRenamed("p", "e").withColumn("y", F.floor(F.col("e.lat") / y_deg))
    ends = ends.withColumn("x", F.floor(F.col("e.lon") / width(F.col("y"))))
    away = reach / F.greatest(F.cos(F.radians(F.abs("s.lat") + reach)), F.lit(1e-4))
    starts = (_places(catalog, 0).withColumnRenamed("p", "s")
              .withColumn("y", cells(F.col("s.lat") - reach, F.col("s.lat") + reach, y_deg))
              .withColumn("x", cells(F.col("s.lon") - away, F.col("s.lon") + away, width(F.col("y")))))
    distance = geo.haversine_ft(F.col("s.lat"), F.col("s.lon"), F.col("e.lat"), F.col("e.lon"))
    return (starts.join(ends, ["project_id", "y", "x"]).withColumn("exact_ft", distance).where(F.col("exact_ft") <= LINK_FT)
            .select("project_id", "e", "s", F.round("exact_ft", 3).alias("distance_ft")))


def neighbours(catalog: DataFrame, bearings: DataFrame, keep: int | None = NEIGHBOURS) -> DataFrame:
    """Per route, its neighbours upstream and downstream: their full numbers `n_up` and `n_down`,
    and the nearest `keep` a side (all, if None) as arrays with role, turn angle, allowed role
    step, two-way link and node score.

    Places are linked, not routes: numbers come from counts at places, and only the first
    `keep` ids of a place are joined with the routes of the other place, so a place where many
    routes end and start costs routes times `keep`, not routes times routes.
    """
    places = cut_lineage(place_links(catalog))
    facts = catalog.select("project_id", "route_id", "route_role").join(bearings, ["project_id", "route_id"])

    def first_ids(index: int, place: str, name: str) -> DataFrame:
        at = _routes_at(catalog, index).select("project_id", F.col("p").alias(place), F.col("route_id").alias(name))
        if keep is None:
            return at
        w = Window.partitionBy("project_id", place).orderBy(name)
        return at.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep + 1).drop("n")

    def near(own: str, own_index: int, own_place: str, other: str, other_index: int, other_place: str) -> DataFrame:
        """Each route with its nearest others, ties to the smaller id."""
        mine = _routes_at(catalog, own_index).select("project_id", F.col("p").alias(own_place), F.col("route_id").alias(own))
        met = mine.join(places, ["project_id", own_place]).join(first_ids(other_index, other_place, other), ["project_id", other_place]).where(F.col(own) != F.col(other))
        met = met.select("project_id", own, other, "distance_ft")
        if keep is None:
            return met
        w = Window.partitionBy("project_id", own).orderBy("distance_ft", other)
        return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")

    def numbers(own: str, own_index: int, own_place: str, other_index: int, other_place: str, name: str) -> DataFrame:
        """How many others each route has: all routes at linked places, but not itself."""
        counts = _routes_at(catalog, other_index).groupBy("project_id", F.col("p").alias(other_place)).agg(F.count("*").alias("n"))
        at_place = places.join(counts, ["project_id", other_place]).groupBy("project_id", own_place).agg(F.sum("n").alias("n"))
        ends = catalog.select("project_id", "route_id", F.element_at("coords", 1).alias("s"), F.element_at("coords", -1).alias("e"))
        itself = geo.haversine_ft(F.col("s.lat"), F.col("s.lon"), F.col("e.lat"), F.col("e.lon")) <= LINK_FT
        return ends.join(at_place, ["project_id", own_place]).select("project_id", "route_id", (F.col("n") - itself.cast("int")).alias(name)).where(F.col(name) > 0)

    up_near = near("to_route", 0, "s", "from_route", -1, "e")
    down_near = near("from_route", -1, "e", "to_route", 0, "s")

    def side(mine: DataFrame, theirs: DataFrame, own: str, other: str, own_bearing: str, other_bearing: str, name: str) -> DataFrame:
        back = theirs.select("project_id", "from_route", "to_route", F.lit(True).alias("back"))
        me = facts.select("project_id", F.col("route_id").alias(own), F.col("route_role").alias("own_role"), F.col(own_bearing).alias("own_b"))
        it = facts.select("project_id", F.col("route_id").alias(other), F.col("route_role").alias("role"), F.col(other_bearing).alias("other_b"))
        allowed = F.coalesce(*[F.when(F.col("own_role") == k, F.col("role").isin(*v)) for k, v in ROLE_TRANSITIONS.items()], F.lit(False))
        full = mine.join(back, ["project_id", "from_route", "to_route"], "left").join(me, ["project_id", own]).join(it, ["project_id", other]).withColumns({
            "back": F.coalesce("back", F.lit(False)), "type_ok": allowed, "angle": F.round(geo.angle_gap_deg(F.col("own_b"), F.col("other_b")), 3)})
        score = F.round(F.col("angle") + F.col("distance_ft") * 2 + F.when(F.col("type_ok"), 0.0).otherwise(1000.0), 3)
        item = F.struct(score.alias("node_score"), "distance_ft", F.col(other).alias("neighbour"), "type_ok", "angle", "back")
        return full.groupBy("project_id", F.col(own).alias("route_id")).agg(F.sort_array(F.collect_list(item)).alias(name))

    up = side(up_near, down_near, "to_route", "from_route", "start_bearing", "end_bearing", "up")
    down = side(down_near, up_near, "from_route", "to_route", "end_bearing", "start_bearing", "down")
    n_up = numbers("to_route", 0, "s", -1, "e", "n_up")
    n_down = numbers("from_route", -1, "e", 0, "s", "n_down")
    key = ["project_id", "route_id"]
    return up.join(n_up, key).join(down.join(n_down, key), key, "full")


#: Ways of anchoring that prove little.
WEAK_ANCHORS = ("", "none", "group_relative_origin", "full_route_fallback", "balanced_span_search")


def validate(anchored: DataFrame) -> DataFrame:
    """Six checks of each hypothesis, its overall status, confidence and failure class."""
    w = Window.partitionBy(*GROUP)

    def of_rank(value: str, rank: str, n: int) -> Column:
        return F.max(F.when(F.col(rank) == n, F.col(value))).over(w)

    relative = (F.col("total_ft") > 0) & (F.col("span_ft") > 0)
    mapped = F.transform("station_rows", lambda r: F.round(F.greatest(F.least(
        F.when(relative, F.col("start_ft") + F.greatest(r["station_ft"] - F.col("min_station_ft"), F.lit(0.0)))
        .otherwise(r["station_ft"] + F.col("start_ft")), F.col("total_ft")), F.lit(0.0)), 2))
    staged = anchored.withColumns({
        "mapped": mapped, "sources": F.transform("station_rows", lambda r: r["station_ft"]),
        "best_combined": of_rank("combined", "anchor_rank", 1), "second_combined": of_rank("combined", "anchor_rank", 2),
        "best_score": of_rank("score", "rank", 1), "second_score": of_rank("score", "rank", 2),
        "top_ranked": of_rank("route_id", "rank", 1), "top_anchored": of_rank("route_id", "anchor_rank", 1)})
    staged = staged.withColumns({"m_steps": _steps(F.col("mapped")), "s_steps": _steps(F.col("sources"))})
    ratios = F.filter(F.transform(F.arrays_zip("m_steps", "s_steps"), lambda z: F.when(z["s_steps"] > 0, F.round(z["m_steps"] / z["s_steps"], 9))),
                      lambda x: x.isNotNull())
    many = F.size("mapped") >= 2
    source_span = F.array_max("sources") - F.array_min("sources")
    drift = F.when(many & (source_span > 0), F.round(F.abs(F.element_at("mapped", -1) - F.get("mapped", F.lit(0)) - source_span) / source_span, 9))
    lead = F.round(F.when(F.col("second_combined").isNull(), 1.0).otherwise(F.col("best_combined") - F.col("second_combined")), 6)
    staged = staged.withColumns({"ratios": ratios, "drift": drift, "lead": lead})
    low, high = F.array_min("ratios"), F.array_max("ratios")
    at_edge = F.greatest(F.size(F.filter("mapped", lambda m: m <= 5.0)),
                         F.size(F.filter("mapped", lambda m: F.round(F.abs(F.col("length_ft") - m), 6) <= 5.0)))
    checks = staged.withColumns({
        "c_ambiguity": F.when(F.col("lead") < 0.02, "fail").when(F.col("lead") < 0.05, "warn").otherwise("pass"),
        "c_monotone": F.when(F.exists("m_steps", lambda d: d <= 0), "fail").otherwise("pass"),
        "c_span": F.when(F.col("drift") > 0.35, "fail").when(F.col("drift") > 0.15, "warn").otherwise("pass"),
        "c_spacing": F.when((low < 0.50) | (high > 1.75), "fail").when((low < 0.80) | (high > 1.25), "warn").otherwise("pass"),
        "c_edge": F.when(at_edge >= 2, "warn").otherwise("pass"),
        "c_anchor": F.when(F.coalesce("anchor_strategy", F.lit("")).isin(*WEAK_ANCHORS), "warn").otherwise("pass")})
    all_checks = F.array("c_ambiguity", "c_monotone", "c_span", "c_spacing", "c_edge", "c_anchor")
    status = F.when(F.array_contains(all_checks, "fail"), "fail").when(F.array_contains(all_checks, "warn"), "warn").otherwise("pass")
    return checks.withColumn("status", status).withColumns({
        "confidence_label": F.when(F.col("status") == "fail", "LOW").when(F.col("status") == "warn", "MEDIUM").otherwise("HIGH"),
        "failure_class": F.when(F.col("c_ambiguity") == "fail", "AMBIGUOUS_MATCH").when(F.col("c_monotone") == "fail", "STATION_NORMALIZATION_ISSUE")
        .when(F.col("c_anchor") != "pass", "BAD_ANCHOR").when(F.col("c_spacing") == "fail", "RIGHT_ROUTE_WRONG_SCALING")
        .when(F.col("c_span") == "fail", "RIGHT_ROUTE_WRONG_POSITION")}).drop("m_steps", "s_steps", "ratios", "drift")


def row_gates(checked: DataFrame, links: DataFrame) -> DataFrame:
    """Billing rule and the gates that look at one hypothesis alone (and its route's neighbours)."""
    n, span = F.size("p_route_ft"), F.col("span_ft")
    cover = F.round((F.col("end_ft") - F.col("start_ft")) / span, 6)
    places = F.size(F.array_distinct(F.zip_with("p_lat", "p_lon", lambda a, b: F.struct(F.round(a, 7), F.round(b, 7)))))
    billing = F.array_compact(F.array(
        F.when(F.col("c_monotone") != "pass", F.concat(F.lit("mapped_station_monotonicity="), "c_monotone")),
        F.when(F.col("c_span") != "pass", F.concat(F.lit("span_integrity="), "c_span")),
        F.when(F.col("c_spacing") != "pass", F.concat(F.lit("spacing_distortion="), "c_spacing")),
        F.when((span > 0) & (cover < 0.90), F.concat(F.lit("segment_coverage_ratio="), F.round(cover, 4).cast("string"))),
        F.when((n > 0) & (places < F.greatest(F.lit(3), F.floor(n * 0.65))), "projected_points_clamped")))
    base = checked.join(links, ["project_id", "route_id"], "left").withColumns({
        "billing_reasons": billing, "rises": _steps(F.col("p_route_ft")), "jumps": _steps(F.col("p_piece")),
        "p_stations": F.col("sources"), "n_up": F.coalesce("n_up", F.lit(0)), "n_down": F.coalesce("n_down", F.lit(0)),
        "near_start": F.col("start_ft") <= 15.0, "near_end": (F.col("length_ft") > 0) & (F.round(F.col("length_ft") - F.col("end_ft"), 6) <= 15.0)})
    base = base.withColumn("station_rises", _steps(F.col("p_stations")))
    # worked out once here, read by several rules below
    base = base.withColumns({
        "n_distinct": F.size(F.array_distinct("p_piece")), "progress_ft": F.array_max("p_route_ft") - F.array_min("p_route_ft"),
        "rising": F.filter("rises", lambda d: d > 0),
        "rates": F.filter(F.zip_with("rises", "station_rises", lambda a, b: F.when(b > 0, F.round(a / b, 9))), lambda x: x.isNotNull())})
    base = base.withColumns({"rise_min": F.round(F.array_min("rising"), 6), "rise_max": F.round(F.array_max("rising"), 6),
                             "rate_min": F.array_min("rates"), "rate_max": F.array_max("rates")})
    pieces = F.col("n_distinct")
    thin = (F.round(pieces / F.greatest(n - 1, F.lit(1)), 9) < 0.20) & (F.round(pieces / F.greatest("n_pieces", F.lit(1)), 9) < 0.20)
    progress = F.col("progress_ft")
    length = F.col("length_ft")

    def off(value: Column, limit: float) -> Column:
        return F.round(F.abs(value), 6) > limit

    outside = F.exists("p_route_ft", lambda v: (F.round(F.col("start_ft") - v, 6) > 5.0) | (F.round(v - F.col("end_ft"), 6) > 5.0))
    near = F.col("near_start") | F.col("near_end")

    def bad(side: str, flag: str, test) -> Column:
        return F.col(flag) & F.exists(F.coalesce(F.col(side), F.array().cast(_SIDE)), test)

    gated = base.withColumns({
        "g_feasible": _verdict(
            (span <= 0, "+within_physical_span_bounds", ""),
            (length < span * 0.85, "route_too_short_for_bore_span", "physical_feasibility_route_too_short"),
            (length > span * 3.50, "route_too_long_for_bore_span", "physical_feasibility_route_too_long"), ok="within_physical_span_bounds"),
        "g_segment": _verdict(
            (n < 4, "insufficient_projected_points", "segment_fit_insufficient_points"),
            (F.exists("rises", lambda d: d <= 0), "non_monotonic_route_progress", "segment_fit_non_monotonic_route_progress"),
            (progress < 250.0, "insufficient_route_progress", "segment_fit_insufficient_route_progress"),
            ((F.size(F.array_distinct("p_seg")) <= 1) & (F.col("n_pieces") <= 1), "+single_segment_route_geometry", ""),
            (thin, "low_unique_segment_ratio", "segment_fit_low_unique_segment_ratio"),
            (F.exists("jumps", lambda d: F.abs(d) > 2), "segment_jump_too_large", "segment_fit_segment_jump_too_large"), ok="segment_fit_valid"),
        "g_boundary": _verdict(
            ((n < 2) | (span <= 0), "insufficient_boundary_points", "boundary_exactness_insufficient_points"),
            (off(progress - span, 10.0), "projected_span_out_of_tolerance", "boundary_exactness_span_out_of_tolerance"),
            (off(F.get("p_route_ft", F.lit(0)) - F.col("start_ft"), 10.0), "start_boundary_out_of_tolerance", "boundary_exactness_start_out_of_tolerance"),
            (off(F.try_element_at("p_route_ft", F.lit(-1)) - F.col("end_ft"), 10.0), "end_boundary_out_of_tolerance", "boundary_exactness_end_out_of_tolerance"),
            (outside, "projected_points_outside_segment_bounds", "boundary_exactness_points_outside_bounds"), ok="boundary_exactness_valid"),
        "g_continuity": _verdict(
            (n < 3, "insufficient_points_for_continuity", "continuity_insufficient_points"),
            (F.exists("rises", lambda d: d < -0.01), "route_overlap_detected", "continuity_route_overlap_detected"),
            (F.size(F.filter("rises", lambda d: d <= 0.01)) / F.greatest(F.size("rises"), F.lit(1)) > 0.20, "too_many_repeated_steps", "continuity_too_many_repeated_steps"),
            (F.col("rise_max") > 80.0, "route_gap_too_large", "continuity_route_gap_too_large"),
            (F.col("rise_min") < 5.0, "route_gap_too_small", "continuity_route_gap_too_small"),
            (F.col("rate_max") > 1.75, "route_station_gap_ratio_too_large", "continuity_route_station_gap_ratio_too_large"),
            (F.col("rate_min") < 0.25, "route_station_gap_ratio_too_small", "continuity_route_station_gap_ratio_too_small"), ok="continuity_valid"),
        "g_chain": _verdict(
            (~near, "+chain_valid", ""),
            (n < 3, "insufficient_points_for_chain_validation", "chain_insufficient_points"),
            (F.col("n_up") + F.col("n_down") > 1, "multiple_possible_chain_links", "chain_not_unique"),
            (F.col("near_start") & (F.col("n_up") == 0), "missing_upstream_chain_link", "chain_missing_upstream_link"),
            (F.col("near_end") & (F.col("n_down") == 0), "missing_downstream_chain_link", "chain_missing_downstream_link"),
            (bad("up", "near_start", lambda x: ~x["back"]) | bad("down", "near_end", lambda x: ~x["back"]), "chain_not_bidirectional", "chain_break_in_topology"),
            (bad("up", "near_start", lambda x: ~x["type_ok"]) | bad("down", "near_end", lambda x: ~x["type_ok"]), "invalid_chain_type_transition", "chain_invalid_topology_type"),
            ok="chain_valid"),
    })

    def unclear(side: str) -> Column:
        best, second = F.get(side, F.lit(0)), F.get(side, F.lit(1))
        return ~best["type_ok"] | (F.round(second["node_score"] - best["node_score"], 6) < 12.0) | (F.round(second["angle"] - best["angle"], 6) < 10.0)

    return gated.withColumn("g_node", _verdict(
        (~F.col("g_chain.passed"), "chain_gate_failed_first", "node_resolution_blocked_by_chain_failure"),
        (F.col("near_start") & unclear("up"), "upstream_node_ambiguous", "node_resolution_upstream_ambiguous"),
        (F.col("near_start") & (F.col("n_up") == 0), "upstream_node_unresolved", "node_resolution_upstream_unresolved"),
        (F.col("near_end") & unclear("down"), "downstream_node_ambiguous", "node_resolution_downstream_ambiguous"),
        (F.col("near_end") & (F.col("n_down") == 0), "downstream_node_unresolved", "node_resolution_downstream_unresolved"),
        ok="node_resolution_valid")).drop(
        "rises", "jumps", "station_rises", "p_stations", "up", "down", "sources", "n_distinct", "progress_ft", "rising", "rates",
        "rise_min", "rise_max", "rate_min", "rate_max")


_SIDE = "array<struct<node_score:double,distance_ft:double,neighbour:string,type_ok:boolean,angle:double,back:boolean>>"
ROW_GATES = ("g_feasible", "g_segment", "g_boundary", "g_continuity", "g_chain", "g_node")


def group_gates(gated: DataFrame) -> DataFrame:
    """Gates that compare the hypotheses of a group: uniqueness, consensus, parallel geometry."""
    w = Window.partitionBy(*GROUP)
    passed = F.size("billing_reasons") == 0
    for gate in ROW_GATES:
        passed = passed & F.col(f"{gate}.passed")
    tags = F.concat("billing_reasons", F.array_compact(F.array(*[F.col(f"{g}.tag") for g in ROW_GATES])))
    b0 = gated.withColumns({"billable": passed, "reasons": tags})

    def winner(*order: Column) -> Column:
        """Route of the best billable row of the group."""
        return F.min_by(F.when(F.col("billable"), F.col("route_id")), F.when(F.col("billable"), F.struct(*order))).over(w)

    sub, comb, route = (-F.col("window_score")).alias("a"), (-F.col("combined")).alias("b"), (-F.col("score")).alias("c")
    b1 = b0.withColumn("unique_winner", winner(sub, comb, route, F.col("route_id").alias("d")))
    is_win = F.col("route_id") == F.col("unique_winner")
    win_sub = F.max(F.when(is_win, F.col("window_score"))).over(w)
    win_comb = F.max(F.when(is_win, F.col("combined"))).over(w)
    b1 = b1.withColumn("rival", F.col("billable") & ~is_win & (
        (F.round(win_sub - F.col("window_score"), 6) < 0.08) | (F.round(win_comb - F.col("combined"), 6) < 0.06)))
    b1 = b1.withColumn("contested", F.max(F.col("rival").cast("int")).over(w) == 1)
    lost = F.col("contested") & (is_win | F.col("rival"))
    b2 = b1.withColumns({"u_lost": F.coalesce(lost, F.lit(False)), "u_tag": F.when(is_win, "route_uniqueness_failed_winner").otherwise("route_uniqueness_failed_competitor")})
    b2 = b2.withColumns({"billable": F.col("billable") & ~F.col("u_lost"),
                         "reasons": F.when(F.col("u_lost"), F.array_append("reasons", F.col("u_tag"))).otherwise(F.col("reasons"))})
    agreed = (F.col("top_ranked") == F.col("top_anchored")) & (
        (F.round(F.col("best_score") - F.coalesce("second_score", F.lit(0.0)), 6) >= 0.03)
        | (F.round(F.col("best_combined") - F.coalesce("second_combined", F.lit(0.0)), 6) >= 0.03))
    b3 = b2.withColumn("consensus_route", F.when(agreed, F.col("top_ranked")))
    outvoted = F.coalesce(F.col("billable") & (F.col("route_id") != F.col("consensus_route")), F.lit(False))
    b3 = b3.withColumn("outvoted", outvoted).withColumns({
        "billable": F.col("billable") & ~F.col("outvoted"),
        "reasons": F.when(F.col("outvoted"), F.array_append("reasons", F.lit("route_consensus_failed"))).otherwise(F.col("reasons"))})
    b4 = b3.withColumn("lock_winner", winner(sub, comb, F.col("route_id").alias("d")))
    is_lock = F.col("route_id") == F.col("lock_winner")
    points = F.max(F.when(is_lock, F.struct("p_lat", "p_lon"))).over(w)
    b4 = b4.withColumn("lock_points", points)
    away = F.transform(F.zip_with("lock_points.p_lat", "lock_points.p_lon", lambda a, b: geo.point(a, b)), lambda p: F.array_min(
        F.transform(F.sequence(F.lit(1), F.size("coords") - 1), lambda i: geo.point_segment_ft(
            p["lat"], p["lon"], F.get("coords", i - 1)["lat"], F.get("coords", i - 1)["lon"], F.get("coords", i)["lat"], F.get("coords", i)["lon"]))))
    rival = F.col("billable") & (F.col("route_id") != F.col("lock_winner"))
    parallel = let(away, lambda d: (F.size(F.filter(d, lambda x: x <= 18.0)) / F.size(d) >= 0.75)
                   & (F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d) <= 15.0) & (F.array_max(d) <= 28.0))
    b5 = b4.withColumn("parallel", F.when(rival, parallel).otherwise(False))
    blocked = F.max(F.coalesce(F.col("parallel"), F.lit(False)).cast("int")).over(w) == 1
    few = F.size("p_route_ft") < 3
    b5 = b5.withColumn("lock_lost", F.coalesce((F.col("route_id") == F.col("lock_winner")) & (few | blocked), F.lit(False)))
    lock_tag = F.when(few, "geometry_lock_insufficient_points").otherwise("geometry_lock_parallel_conflict")
    b6 = b5.withColumns({
        "billable": F.col("billable") & ~F.col("lock_lost"),
        "reasons": F.when(F.col("lock_lost"), F.array_append("reasons", lock_tag)).otherwise(F.col("reasons")),
        "lock_reason": F.when(F.col("lock_lost"), F.when(few, "insufficient_projected_points").otherwise("parallel_route_conflict"))})
    return b6.drop("lock_points", "parallel", "rival", "contested", "u_tag", "unique_winner", "lock_winner", "outvoted")


def choose(gated: DataFrame) -> DataFrame:
    """Evaluation order inside each group; the first is the group's match.

    With a consensus route it comes first; then billable ones, by score.
    """
    held = F.coalesce(F.col("route_id") == F.col("consensus_route"), F.lit(False))
    agreed = F.max(held.cast("int")).over(Window.partitionBy(*GROUP)) == 1
    staged = gated.withColumns({"committed": held, "_agreed": agreed})
    a, b, c = F.desc("score"), F.desc("combined"), F.desc("window_score")
    with_c = Window.partitionBy(*GROUP).orderBy(F.desc("committed"), F.desc("billable"), a, b, c, F.asc("route_name"), F.asc("route_id"))
    without = Window.partitionBy(*GROUP).orderBy(F.desc("billable"), c, b, a, F.asc("route_name"), F.asc("route_id"))
    return staged.withColumn("eval_rank", F.when(F.col("_agreed"), F.row_number().over(with_c)).otherwise(F.row_number().over(without))).drop("_agreed")


# Block reasons that a preview drops.
PREVIEW_DROPS = ("within_route_anchor_overlap_conflict", "batch_level_conflict_resolution", "chain_gate:multiple_possible_chain_links",
                 "node_resolution_gate:chain_gate_failed_first", "multiple_possible_chain_links", "chain_gate_failed_first")


def render_policy(chosen: DataFrame) -> DataFrame:
    """Block reasons and whether a hypothesis may be shown.

    Only a match without geometry or with a broken chain is blocked; a chain that is merely
    ambiguous at a route end may still be previewed when everything else holds.
    """
    def failed(col: str, label: str) -> Column:
        return F.when(~F.col(f"{col}.passed"), F.concat(F.lit(label + ":"), F.col(f"{col}.reason")))

    hard = F.array_compact(F.array(
        F.when(F.col("status") == "fail", "validation_status:fail"),
        F.when(F.col("u_lost"), "route_uniqueness_gate:multiple_billable_routes"),
        F.when(F.col("lock_lost"), F.concat(F.lit("geometry_lock_gate:"), "lock_reason")),
        failed("g_chain", "chain_gate"), failed("g_node", "node_resolution_gate")))
    soft = F.concat("reasons", F.array_compact(F.array(
        failed("g_feasible", "physical_feasibility_gate"), failed("g_segment", "segment_fit_gate"),
        failed("g_boundary", "boundary_exactness_gate"), failed("g_continuity", "continuity_gate"))))
    safe = ((F.col("status") == "pass") & (F.col("g_chain.reason") == "multiple_possible_chain_links")
            & (F.col("g_node.reason") == "chain_gate_failed_first") & F.col("g_feasible.passed") & F.col("g_continuity.passed")
            & F.col("g_segment.passed") & F.col("g_boundary.passed") & (F.col("near_start") | F.col("near_end"))
            & (F.col("consensus_route").isNull() | F.col("committed")))
    geometry = F.exists(_steps(F.col("mapped")), lambda d: d > 0)
    staged = chosen.withColumns({"gate_reasons": F.array_distinct(F.when(F.size(hard) > 0, hard).otherwise(soft)),
                                 "preview_safe": safe, "has_geometry": geometry})
    stops = F.array_compact(F.array(
        F.when(~F.col("has_geometry"), "no_geometry_output"),
        F.when(~F.col("g_chain.passed") & ~F.col("preview_safe"), F.col("g_chain.reason"))))
    keep = F.filter("gate_reasons", lambda r: ~r.isin(*PREVIEW_DROPS))
    review = F.array_compact(F.concat(
        F.when(F.col("preview_safe"), F.array(F.lit("chain_gate:multiple_possible_chain_links"), F.lit("node_resolution_gate:chain_gate_failed_first"),
                                              F.lit("endpoint_chain_ambiguity_preview_only"))).otherwise(F.array().cast("array<string>")),
        F.array(*[F.when(~F.col(f"{g}.passed"), F.col(f"{g}.reason")) for g in ("g_feasible", "g_continuity", "g_segment")])))
    return staged.withColumn("stops", stops).withColumns({
        "render_allowed": F.size("stops") == 0,
        "block_reasons": F.when(F.size("stops") > 0, F.concat("gate_reasons", "stops")).otherwise(keep),
        "review_reasons": F.when(F.size("stops") == 0, review).otherwise(F.array().cast("array<string>"))}).drop("stops")
