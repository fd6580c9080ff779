"""No two groups own the same stretch: ordered claims on routes, settled exactly.

Claims depend on order, and a group may move to another of its evaluated routes.  The unit of
work is a route: its own groups, and those that moved to it, are settled in order in one task.
A move only matters to later groups of the route it goes to, so rounds are repeated until the
moves no longer change; a round settles the routes again whose arrivals changed in the round
before, and no others.  The order has no cycles, so that state is the sequential result, and
the number of rounds follows the longest chain of moves.  Claims of a route are kept in order
(`intervals.Claims`), so a route of many groups costs little more than its groups' windows.
A task walks its routes row by row in one ordered pass, with no call of its own for a route.
Only a group's present route carries its chainage.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trenchline.operators.grouping import GROUP
from trenchline.operators.intervals import Claims
from trenchline.operators.ordered import TYPES
from trenchline.operators.windows import bias_of, flat, half_up, leading_windows, line_of, scored_windows, sheet_fractions, windows_of
from trenchline.session import stored

HARD_OVERLAP_FT = 5.0
#: Columns that order groups, in turn, and whether they rise.
INPUT_ORDER = (("source_file", True), ("tokens_key", True), ("min_station_ft", True), ("group_id", True))
RANKED = (("rank_combined", False), ("rank_window", False), ("span_ft", False), *INPUT_ORDER)
_PLACE = "project_id string, group_id string, source_file string, tokens_key string, min_station_ft double, span_ft double, rank_combined double, rank_window double"
SETTLED = _PLACE + ", route_id string, start_ft double, end_ft double, window_score double, combined double, accepted boolean, reselected boolean, reason string, choice int, shown boolean, leaves boolean, settled_at string"


def overlap_ft(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared feet of two ranges, each in either direction."""
    left = F.greatest(F.least(a0, a1), F.least(b0, b1))
    right = F.least(F.greatest(a0, a1), F.greatest(b0, b1))
    return F.greatest(F.lit(0.0), right - left)


def same_print_zone(sheets_a: Column, sheets_b: Column, streets_a: Column, streets_b: Column) -> Column:
    """Near sheets, or a shared street on sheets at most two apart (or on no sheets at all)."""
    gap = F.array_min(F.flatten(F.transform(sheets_a, lambda a: F.transform(sheets_b, lambda b: F.abs(a - b)))))
    shared = F.size(F.array_intersect(F.transform(streets_a, lambda s: F.upper(F.trim(s))), F.transform(streets_b, lambda s: F.upper(F.trim(s))))) > 0
    none = (F.size(sheets_a) == 0) & (F.size(sheets_b) == 0)
    return F.coalesce(gap <= 1, F.lit(False)) | (shared & F.coalesce(gap <= 2, F.lit(False))) | (shared & none)


def conflict_columns(a0: Column, a1: Column, b0: Column, b1: Column) -> dict[str, Column]:
    """Overlap facts of two windows on one route; `conflict` when the overlap is material."""
    span_a, span_b = F.greatest(F.lit(1.0), F.abs(a1 - a0)), F.greatest(F.lit(1.0), F.abs(b1 - b0))
    least, over = F.least(span_a, span_b), overlap_ft(a0, a1, b0, b1)
    gap = F.abs((a0 + a1) / 2 - (b0 + b1) / 2)
    tolerance = F.least(F.lit(30.0), F.greatest(F.lit(5.0), least * 0.06))
    near = gap <= F.greatest(F.lit(25.0), least * 0.10)
    return {
        "overlap_ft": F.round(over, 2), "overlap_ratio": F.round(over / F.greatest(F.lit(1.0), least), 6),
        "centre_gap_ft": F.round(F.round(gap, 6), 2), "span_similarity": F.round(least / F.greatest(span_a, span_b), 6),
        "near_duplicate": near, "conflict": (over > tolerance) & ((over / least >= 0.12) | near)}


def conflict_pairs(claims: DataFrame, width_ft: float = 200.0) -> DataFrame:
    """Overlapping claims on a route, by an equi-join on stretches of the route.

    A pair is reported once, in the stretch where its overlap begins.
    """
    cut = claims.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_ft") / width_ft).cast("int"), F.floor(F.col("end_ft") / width_ft).cast("int"))))
    a = cut.select("project_id", "route_id", "_bin", *[F.col(c).alias(f"a_{c}") for c in ("group_id", "start_ft", "end_ft", "sheets", "streets")])
    b = cut.select("project_id", "route_id", "_bin", *[F.col(c).alias(f"b_{c}") for c in ("group_id", "start_ft", "end_ft", "sheets", "streets")])
    first = F.floor(F.greatest("a_start_ft", "b_start_ft") / width_ft).cast("int") == F.col("_bin")
    meet = overlap_ft(*[F.col(c) for c in ("a_start_ft", "a_end_ft", "b_start_ft", "b_end_ft")])
    pairs = a.join(b, ["project_id", "route_id", "_bin"]).where((F.col("a_group_id") < F.col("b_group_id")) & first & (meet > 0))
    facts = conflict_columns(*[F.col(c) for c in ("a_start_ft", "a_end_ft", "b_start_ft", "b_end_ft")])
    return pairs.withColumns({**facts, "same_zone": same_print_zone(*[F.col(c) for c in ("a_sheets", "b_sheets", "a_streets", "b_streets")])}).drop("_bin")


def _options(hyp: dict, rel, span: float, sheets, lines: dict):
    """Every window of a hypothesis but the present one, with score and bias; a route without length has none."""
    if hyp["chain"] is None or len(hyp["chain"]) < 2:
        return (np.empty(0),) * 4
    _, start, end, _, score, bias = scored_windows(hyp["chain"], rel, span, sheet_fractions(sheets, hyp["route_sheets"]), lines)
    other = (np.abs(start - hyp["start_ft"]) >= 1e-6) | (np.abs(end - hyp["end_ft"]) >= 1e-6)
    return start[other], end[other], score[other], bias[other]


def _free_window(row, hyp: dict, claims: Claims, span: float, centre: float) -> tuple[float, float, float] | None:
    """(start, end, score) of the best other window of a hypothesis that no claim overlaps."""
    if hyp["chain"] is None or len(hyp["chain"]) < 2:
        return None
    line = line_of(hyp["chain"], claims.lines)
    start, end, _ = windows_of(line, row.span_ft)
    free = (np.abs(start - hyp["start_ft"]) >= 1e-6) | (np.abs(end - hyp["end_ft"]) >= 1e-6)
    free &= claims.overlaps(start, end) <= HARD_OVERLAP_FT
    if not free.any():
        return None
    rel = np.asarray(row.rel, dtype=float)
    bias = bias_of(line, row.span_ft, sheet_fractions(row.sheets, hyp["route_sheets"]))
    _, j, score, bias = leading_windows(line, row.span_ft, rel, np.array([0]), np.array([len(rel)]), bias[None, :], free[None, :])
    k = np.lexsort((start[j], np.abs((start[j] + end[j]) / 2 - centre), np.abs(np.abs(end[j] - start[j]) - span), -bias, -score))[0]
    return start[j[k]], end[j[k]], score[k]


def _moved(hyp: dict, start: float, end: float, score: float) -> dict:
    return {**hyp, "start_ft": float(half_up(start, 2)), "end_ft": float(half_up(end, 2)), "window_score": float(score),
            "combined": float(half_up(min(1.0, hyp["score"] + score * 0.35), 6))}


def separate(row, choice: int, claims: Claims) -> tuple[int, dict, bool, str]:
    """Where a group may stand given the claims of its route: its own window, another on the
    route, or its next evaluated route.  Returns (choice, hypothesis, moved, reason)."""
    hyp = row.hyps[choice]
    route, s, e = hyp["route_id"], hyp["start_ft"], hyp["end_ft"]
    span, length = max(1.0, abs(e - s)), hyp["length_ft"]
    centre = (s + e) / 2
    clash = claims.overlaps(np.array([s]), np.array([e]))[0] > HARD_OVERLAP_FT
    if not clash:
        if length > 0 and span / max(length, 1.0) >= 0.94 and (s <= 12.0 or length - e <= 12.0):
            start, end, score, _ = _options(hyp, row.rel, row.span_ft, row.sheets, claims.lines)
            clear = np.minimum(start, np.maximum(0.0, length - end))
            ok = np.flatnonzero((clear > 4.0) & (score + 0.03 >= hyp["window_score"]))
            if len(ok):
                k = ok[np.lexsort((start[ok], np.abs((start[ok] + end[ok]) / 2 - centre), -score[ok], -clear[ok]))[0]]
                return choice, _moved(hyp, start[k], end[k], score[k]), True, "edge_locked_window_reselected_inward"
        return choice, hyp, False, "no_within_route_overlap_conflict"
    if (free := _free_window(row, hyp, claims, span, centre)) is not None:
        return choice, _moved(hyp, *free), True, "reselected_to_non_overlapping_subsection_same_route"
    for i, other in enumerate(row.hyps):
        if other["route_id"] != route:
            return i, other, True, "reselected_to_non_conflicting_route"
    return choice, hyp, False, "within_route_overlap_conflict_no_safe_alternative"


def _first_pass(row, claims: Claims) -> tuple[int, dict, bool, bool, str]:
    """(choice, hypothesis, accepted, moved, reason): input order; only a forced change of route counts, and only without a consensus route."""
    choice, reason = row.choice, "kept"
    if not row.has_consensus:
        picked, _, _, why = separate(row, choice, claims)
        if picked != choice:
            choice, reason = picked, why
    hyp = row.hyps[choice]
    return choice, hyp, bool(hyp["render_allowed"]), choice != row.choice, reason


def _first_arrival(row, claims: Claims) -> tuple[bool, str]:
    return bool(row.shown), row.reason


def _second_pass(always: bool):
    """Priority order; each group moves off accepted claims or is blocked as a duplicate."""
    def judged(start: float, end: float, reason: str, claims: Claims) -> tuple[bool, str]:
        conflict, duplicate = claims.duplicate(start, end)
        accepted = always or not duplicate
        if not accepted:
            reason = "hard_no_overlap_conflict_no_safe_alternative"
        elif conflict:
            reason = "salvaged_distinct_subsection_with_geometry"
        return accepted, reason

    def own(row, claims: Claims):
        choice, hyp, moved, reason = row.choice, row.hyps[row.choice], False, "first_claim"
        if not row.leader:
            choice, hyp, moved, reason = separate(row, row.choice, claims)
        if choice != row.choice:
            return choice, hyp, True, moved, reason
        accepted, reason = judged(hyp["start_ft"], hyp["end_ft"], reason, claims)
        return choice, hyp, accepted, moved, reason

    def arrival(row, claims: Claims):
        return judged(row.start_ft, row.end_ft, row.reason, claims)

    return own, arrival


#: What a pass reads of a row besides its keys and places; arrivals lack what only own groups need.
_READ = ("choice", "shown", "reason", "start_ft", "end_ft", "window_score", "combined", "leader", "has_consensus", "hyps", "sheets", "route_sheets")
_HYP = ("route_id", "start_ft", "end_ft", "window_score", "combined", "score", "length_ft", "render_allowed")


def _walk(own, arrival):
    """Rows of routes, each in its order, to `SETTLED`: a new route starts with no claims."""
    columns = [c.strip().split(" ") for c in SETTLED.split(", ")]
    schema = pa.schema([(c, TYPES[t]) for c, t in columns])
    place = [c.strip().split(" ")[0] for c in _PLACE.split(", ")]
    Row = namedtuple("Row", dict.fromkeys(("route_id", *place, "arrives", *_READ, "rel", "chain")))

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def lists(column: pa.Array) -> list[np.ndarray]:
        values, first, size = flat(column)
        return [values[a:a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, claims, held = None, Claims(), []
        for batch in batches:
            read = [lists(batch[c]) if c in ("rel", "chain") else batch[c].to_pylist() for c in Row._fields]
            for row in map(Row._make, zip(*read, strict=True)):
                if key != (here := (row.project_id, row.route_id)):
                    key, claims = here, Claims()
                if row.arrives:
                    accepted, reason = arrival(row, claims)
                    found = (row.route_id, row.start_ft, row.end_ft, row.window_score, row.combined, accepted, True, reason, row.choice, bool(row.shown), False, key[1])
                else:
                    row.hyps[row.choice].update(chain=row.chain, route_sheets=row.route_sheets)
                    choice, hyp, accepted, moved, reason = own(row, claims)
                    found = (hyp["route_id"], hyp["start_ft"], hyp["end_ft"], hyp["window_score"], hyp["combined"], bool(accepted), moved, reason, int(choice),
                             bool(hyp["render_allowed"]), hyp["route_id"] != row.route_id, key[1])
                if accepted and not found[-2]:
                    claims.add(found[1], found[2])
                held.append((*row[1:1 + len(place)], *found))
            if len(held) >= 10_000:
                yield made(held)
                held.clear()
        if held:
            yield made(held)

    return run, list(Row._fields)


def _settle(groups: DataFrame, own, arrival, order: tuple, max_rounds: int = 1000) -> DataFrame:
    """Settle all routes in rounds; groups: the columns of `_PLACE`, choice, hyps and what `own` reads."""
    place = [c.strip().split(" ")[0] for c in _PLACE.split(", ")]
    present = F.get("hyps", F.col("choice"))
    slim = F.transform("hyps", lambda h: F.struct(*[h[c].alias(c) for c in _HYP]))
    home = stored(groups.select(*place, "choice", "leader", "has_consensus", "rel", "sheets", present["route_id"].alias("route_id"), present["chain"].alias("chain"),
                                present["route_sheets"].alias("route_sheets"), slim.alias("hyps"), F.lit(False).alias("arrives")), "home")
    keys = ["project_id", "route_id"]
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    run, names = _walk(own, arrival)

    def settled(of: DataFrame, arriving: DataFrame | None = None) -> DataFrame:
        if arriving is not None:
            moved = arriving.select("route_id", *place, "choice", "shown", "reason", "start_ft", "end_ft", "window_score", "combined", F.lit(True).alias("arrives"))
            of = of.unionByName(moved, allowMissingColumns=True)
        else:
            of = of.withColumns({c: F.lit(None).cast(t) for c, t in (("shown", "boolean"), ("reason", "string"), *[(c, "double") for c in ("start_ft", "end_ft", "window_score", "combined")])})
        ordered = of.select(*names).repartition(*keys).sortWithinPartitions(*keys, *by, "arrives")
        return stored(ordered.mapInArrow(run, SETTLED), "settled")

    # what each route said when it was settled last: all routes first, then those with other arrivals than before
    said = [settled(home)]
    settled_again: list[DataFrame] = []
    arrived = said[0].where("leaves").limit(0)
    moves = stored(said[0].where("leaves"), "moves")
    for _ in range(max_rounds):
        routes = stored(_changed(arrived, moves, keys), "routes")
        if routes.isEmpty():
            return _last_said(said, settled_again, keys).where("not leaves")
        again = settled(home.join(routes, keys, "left_semi"), moves.join(routes, keys, "left_semi"))
        said.append(again)
        settled_again.append(routes)
        # `settled_at` is the route that gave a row: for a move the one it leaves
        left = routes.withColumnRenamed("route_id", "settled_at")
        arrived, moves = moves, stored(moves.join(left, ["project_id", "settled_at"], "left_anti").unionByName(again.where("leaves")), "moves")
    raise RuntimeError("claims did not settle")


def _changed(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Routes whose arrivals are not what they were."""
    columns = [*keys, "group_id", "start_ft", "end_ft", "shown"]
    old, new = before.select(*columns), now.select(*columns)
    return old.exceptAll(new).select(*keys).union(new.exceptAll(old).select(*keys)).distinct()


def _last_said(said: list[DataFrame], settled_again: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of each route from the round that settled it last."""
    out = later = None
    for rows, routes in zip(reversed(said), [*reversed(settled_again), None], strict=True):
        mine = rows if later is None else rows.join(later.withColumnRenamed("route_id", "settled_at"), ["project_id", "settled_at"], "left_anti")
        out = mine if out is None else out.unionByName(mine)
        if routes is not None:
            later = routes if later is None else later.union(routes).distinct()
    return out


def claim_inputs(evaluated: DataFrame) -> DataFrame:
    """One row per group: its evaluated hypotheses in order with what is needed to move them."""
    hyp = F.struct("eval_rank", "route_id", "start_ft", "end_ft", "window_score", "combined", "score", "length_ft", "render_allowed",
                   "billable", "status", "chain", "route_sheets")
    return evaluated.groupBy(*GROUP, "source_file", "tokens_key", "min_station_ft", "span_ft").agg(
        F.sort_array(F.collect_list(hyp)).alias("hyps"), F.first("rel").alias("rel"), F.first("sheets").alias("sheets"),
        F.first("streets").alias("streets"), F.max(F.col("consensus_route").isNotNull()).alias("has_consensus"))


def resolve(claims: DataFrame, input_order: bool = False) -> DataFrame:
    """Both passes over all projects.  `input_order` keeps the input order and shows every group."""
    null = F.lit(None).cast("double")
    groups = claims.withColumns({"choice": F.lit(0), "leader": F.lit(False), "rank_combined": null, "rank_window": null})
    first = _settle(groups, _first_pass, _first_arrival, INPUT_ORDER)
    picked = claims.join(first.where("accepted").select(*GROUP, "choice", F.col("combined").alias("rank_combined"), F.col("window_score").alias("rank_window")), GROUP)
    order = INPUT_ORDER if input_order else RANKED
    lead = picked.groupBy("project_id").agg(F.min_by("group_id", F.struct(*[F.col(c).alias(f"k{i}") if up else (-F.col(c)).alias(f"k{i}") for i, (c, up) in enumerate(order)])).alias("first"))
    shown = picked.join(lead, "project_id").withColumn("leader", F.col("group_id") == F.col("first")).drop("first")
    settled = _settle(shown, *_second_pass(input_order), order)
    hidden = first.where("not accepted").withColumn("reason", F.lit("not_render_eligible_before_batch_pass"))
    return settled.unionByName(hidden).drop("shown", "leaves", "settled_at", "rank_combined", "rank_window", "source_file", "tokens_key", "min_station_ft", "span_ft")
