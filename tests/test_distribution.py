"""Results do not depend on blocks, batches, salts or partitioning."""

import heapq
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from trenchline.operators import coverage, network, ownership, quality, sequences, walks
from trenchline.operators.intervals import Claims
from trenchline.operators.windows import half_up, scored_windows, sheet_fractions
from trenchline.plans.inputs import view
from trenchline.plans.pipeline import Job
from trenchline.plans.queries_quality import LOG, clean_rows


def rows(df):
    return sorted(map(repr, df.collect()))


def test_blocks_equal_plain_windows(spark, monkeypatch):
    data = clean_rows(spark, SF_DIR)
    real = sequences.split_blocks
    monkeypatch.setattr(quality, "split_blocks", lambda df, keys, block: real(df, keys, F.floor(F.col("station_ft") / 70)))
    blocked = rows(quality.deviation_spans(data, LOG))
    monkeypatch.setattr(quality, "split_blocks", lambda df, keys, block: df)
    assert rows(quality.deviation_spans(data, LOG)) == blocked and blocked


def test_walk_blocks(spark, monkeypatch):
    fixes = view(spark, SF_DIR, "gps_fixes").withColumn("t_s", walks.seconds(F.col("ts")))
    blocked = rows(walks.split_walks(fixes, 86400.0).select("event_id", "walk_s"))
    monkeypatch.setattr(walks, "split_blocks", lambda df, keys, block: df.withColumn("_block", F.lit(0)).drop("_block"))
    assert rows(walks.split_walks(fixes, 86400.0).select("event_id", "walk_s")) == blocked


def test_positions_across_blocks(spark):
    df = spark.range(50).withColumn("k", F.col("id") % 2)
    blocked = sequences.split_blocks(df, ["k"], F.floor(F.col("id") / 7))
    assert rows(sequences.with_position(blocked, ["k"], ["id"], "n").select("id", "n")) == rows(sequences.with_position(df, ["k"], ["id"], "n").select("id", "n"))


def test_rows_without_a_place_stay(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 3.0, 2), ("k", 900.0, 3)], "k string, ft double, id long")
    near = sequences.with_neighbours(sequences.split_blocks(df, ["k"], F.floor(F.col("ft") / 100)), ["k"], ["ft", "id"], ["id"])
    assert {(r.id, r.prev and r.prev.id, r.next and r.next.id) for r in near.collect()} == {(1, None, 2), (2, 1, 3), (3, 2, None)}


@pytest.fixture(scope="module")
def job(spark):
    return Job.of(spark, SF_DIR)


def shared(s, e, held):
    return max([0.0, *(min(e, b) - max(s, a) for a, b in held)])


def best_window(g, hyp, held, inward):
    """The best other window of a hypothesis, looking at every one in turn; None if none will do."""
    _, starts, ends, _, scores, biases = scored_windows(hyp["chain"], g.rel, g.span_ft, sheet_fractions(g.sheets, hyp["route_sheets"]))
    s0, e0 = hyp["start_ft"], hyp["end_ft"]
    span, found = max(1.0, e0 - s0), []
    for s, e, score, bias in zip(starts, ends, scores, biases, strict=True):
        if abs(s - s0) < 1e-6 and abs(e - e0) < 1e-6:
            continue
        drift = abs((s + e) / 2 - (s0 + e0) / 2)
        if inward:
            clear = min(s, max(0.0, hyp["length_ft"] - e))
            if clear > 4 and score + 0.03 >= hyp["window_score"]:
                found.append((-clear, -score, drift, s, e))
        elif shared(s, e, held) <= 5:
            found.append((-score, -bias, abs(abs(e - s) - span), drift, s, e))
    if not found:
        return None
    *key, s, e = min(found)
    score = -key[1] if inward else -key[0]
    return {**hyp, "start_ft": float(half_up(s, 2)), "end_ft": float(half_up(e, 2)), "window_score": score,
            "combined": float(half_up(min(1.0, hyp["score"] + score * 0.35), 6))}


def stand(g, choice, held):
    """Where a group stands given the claims (start, end) on its route."""
    hyp = g.hyps[choice]
    s, e, length = hyp["start_ft"], hyp["end_ft"], hyp["length_ft"]
    if shared(s, e, held) <= 5:
        fills = length > 0 and (e - s) / max(length, 1.0) >= 0.94 and (s <= 12 or length - e <= 12)
        if fills and (other := best_window(g, hyp, held, True)):
            return choice, other, True, "edge_locked_window_reselected_inward"
        return choice, hyp, False, "no_within_route_overlap_conflict"
    if other := best_window(g, hyp, held, False):
        return choice, other, True, "reselected_to_non_overlapping_subsection_same_route"
    for i, other in enumerate(g.hyps):
        if other["route_id"] != hyp["route_id"]:
            return i, other, True, "reselected_to_non_conflicting_route"
    return choice, hyp, False, "within_route_overlap_conflict_no_safe_alternative"


def conflicts(s, e, held):
    """(any material conflict, any true duplicate) with claims on the route."""
    any_ = true = False
    for a, b in held:
        over, mine, its = min(e, b) - max(s, a), max(1.0, e - s), max(1.0, b - a)
        short, long = min(mine, its), max(mine, its)
        least_overlap = min(30.0, max(5.0, 0.06 * short))
        near = abs((s + e) / 2 - (a + b) / 2) <= max(25.0, 0.1 * short)
        if over > least_overlap and (over / short >= 0.12 or near):
            any_ = True
            true |= near or (over / short >= 0.5 and short / long >= 0.7) or over >= max(80.0, 3 * least_overlap)
    return any_, true


def settle_by_hand(groups, input_order):
    by_input = sorted(groups, key=lambda r: (r.project_id, r.source_file, r.tokens_key, r.min_station_ft, r.group_id))
    held, first, out = defaultdict(list), {}, []
    for g in by_input:
        choice = 0 if g.has_consensus else stand(g, 0, held[g.project_id, g.hyps[0]["route_id"]])[0]
        h = g.hyps[choice]
        if h["render_allowed"]:
            held[g.project_id, h["route_id"]].append((h["start_ft"], h["end_ft"]))
            first[g.group_id] = (choice, h)
        else:
            out.append((g.group_id, h["route_id"], h["start_ft"], h["end_ft"], False, choice != 0, "not_render_eligible_before_batch_pass"))
    shown = [g for g in by_input if g.group_id in first]
    if not input_order:
        shown.sort(key=lambda g: (-first[g.group_id][1]["combined"], -first[g.group_id][1]["window_score"], -g.span_ft))
    held, led = defaultdict(list), set()
    for g in shown:
        choice, h = first[g.group_id]
        moved, reason = False, "first_claim"
        if g.project_id in led:
            choice, h, moved, reason = stand(g, choice, held[g.project_id, h["route_id"]])
        led.add(g.project_id)
        any_, true = conflicts(h["start_ft"], h["end_ft"], held[g.project_id, h["route_id"]])
        accepted = input_order or not true
        reason = "hard_no_overlap_conflict_no_safe_alternative" if not accepted else "salvaged_distinct_subsection_with_geometry" if any_ else reason
        if accepted:
            held[g.project_id, h["route_id"]].append((h["start_ft"], h["end_ft"]))
        out.append((g.group_id, h["route_id"], h["start_ft"], h["end_ft"], accepted, moved, reason))
    return sorted(out)


@pytest.mark.parametrize("input_order", [False, True])
def test_ownership_against_plain_loop(spark, job, input_order):
    """Rounds over routes settle what one loop over all groups settles; some claims are crowded so that groups must change route."""
    crowd = job.claims.where(F.size("hyps") >= 2)
    hyps = F.transform("hyps", lambda h: h.withField("start_ft", F.round(h["start_ft"] / 300) * 300).withField("end_ft", F.round(h["start_ft"] / 300) * 300 + 280).withField("length_ft", F.lit(300.0)).withField("render_allowed", F.lit(True)))
    tight = crowd.withColumns({"hyps": hyps, "span_ft": F.lit(1e6), "group_id": F.concat("group_id", F.lit("x")), "has_consensus": F.lit(False)})
    claims = job.claims.unionByName(tight)
    keep = ["group_id", "route_id", "start_ft", "end_ft", "accepted", "reselected", "reason"]
    found = sorted(tuple(r) for r in ownership.resolve(claims, input_order=input_order).select(*keep).collect())
    groups = [SimpleNamespace(**r.asDict(recursive=True)) for r in claims.collect()]
    assert found == settle_by_hand(groups, input_order)
    # groups leave their best route in the first pass of either order, and in the second by rank
    best = {g.group_id: g.hyps[0]["route_id"] for g in groups}
    assert any(route != best[group] for group, route, *_ in found)
    assert input_order or any(r[-1] == "reselected_to_non_conflicting_route" for r in found)
    assert any(r[-1] == "reselected_to_non_overlapping_subsection_same_route" for r in found)


def test_claims_answer_as_a_plain_list_does():
    rng = np.random.default_rng(2)
    for lengths in ([30.0], [1.0, 50.0, 900.0], [0.0, 5.0]):
        claims, held = Claims(), []
        for _ in range(400):
            s = float(np.round(rng.uniform(0, 3000), 0))
            e = s + float(rng.choice(lengths)) * float(np.round(rng.uniform(0.5, 1.5), 2))
            start = np.round(rng.uniform(-50, 3000, 20), 0)
            end = start + rng.choice([0.0, 10.0, 300.0], 20)
            assert claims.overlaps(start, end).tolist() == [shared(a, b, held) for a, b in zip(start, end, strict=True)]
            assert claims.duplicate(float(start[0]), float(end[0])) == conflicts(start[0], end[0], held)
            claims.add(s, e)
            held.append((s, e))


def test_route_with_very_many_groups_takes_seconds():
    """20,000 groups on one route, each looking at 100 windows: no step goes over all claims."""
    import time

    rng = np.random.default_rng(4)
    claims, began = Claims(), time.time()
    for _ in range(20_000):
        start = rng.uniform(0, 2_000_000, 100)
        free = np.flatnonzero(claims.overlaps(start, start + 90) <= 5)
        s = float(start[free[0] if len(free) else 0])
        claims.duplicate(s, s + 90)
        claims.add(s, s + 90)
    assert time.time() - began < 20


def test_no_true_duplicates_are_accepted(job):
    pairs = ownership.conflict_pairs(job.owned.where("accepted").join(job.claims.select("project_id", "group_id", "sheets", "streets"), ["project_id", "group_id"]))
    bad = pairs.where("conflict AND (near_duplicate OR (overlap_ratio >= 0.5 AND span_similarity >= 0.7))")
    assert bad.count() == 0


def test_scores_within_bounds(job):
    bad = job.anchored.where("window_score < 0 OR window_score > 1 OR combined < 0 OR combined > 1 OR end_ft < start_ft")
    assert bad.count() == 0


def test_deduplicate_against_plain_loop(spark):
    built = view(spark, SF_DIR, "built")
    got = sorted(tuple(r) for r in coverage.deduplicate(built).select("route_id", "source_file", "crew", "date", "start_ft", "end_ft").collect())
    groups = defaultdict(set)
    for r in built.collect():
        groups[(r.route_id, r.source_file, r.crew, r.date)].add((min(r.start_ft, r.end_ft), max(r.start_ft, r.end_ft)))
    want = []
    for key, items in groups.items():
        kept = []
        for s, e in sorted(i for i in items if i[1] > i[0]):
            parts = [(s, e)]
            for hs, he in kept:
                following = []
                for ps, pe in parts:
                    over = max(0.0, min(pe, he) - max(ps, hs))
                    ratio = over / max(min(pe - ps, he - hs), 1e-9)
                    if ratio > 0.85:
                        continue
                    if ratio > 0.5:
                        options = ([(ps, min(pe, hs))] if ps < hs else []) + ([(max(ps, he), pe)] if pe > he else [])
                        following += [o for o in options if o[1] - o[0] > 0.01]
                    else:
                        following.append((ps, pe))
                parts = following
            kept += parts
        want += [(*key, round(a, 2), round(b, 2)) for a, b in kept]
    assert got == sorted(want)


def test_paths_against_plain_search(spark):
    links = [("a", "b", 100.0, "s1"), ("b", "c", 50.0, "s2"), ("a", "c", 200.0, "s3"), ("c", "d", 700.0, "s4"), ("c", "e", 10.0, "s5")]
    both = [("p", x, y, w, s) for x, y, w, s in links] + [("p", y, x, w, s) for x, y, w, s in links]
    df = spark.createDataFrame(both, "project_id string, src string, dst string, length_ft double, segment_id string")
    nodes = spark.createDataFrame([("p", n) for n in "abcde"], "project_id string, node string")
    got = {(r.src, r.node): r.feet for r in network.shortest_paths(df, nodes, 800.0).collect()}
    near = defaultdict(list)
    for _, x, y, w, _s in both:
        near[x].append((y, w))
    want = {}
    for s in "abcde":
        best, heap = {}, [(0.0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in best or d > 800.0:
                continue
            best[n] = d
            for m, w in near[n]:
                heapq.heappush(heap, (d + w, m))
        want.update({(s, n): d for n, d in best.items()})
    assert got == want


def test_repartitioning_changes_nothing(spark):
    built = view(spark, SF_DIR, "built")
    keys = ["project_id", "route_id"]
    assert rows(coverage.merge_intervals(built.repartition(13), keys)) == rows(coverage.merge_intervals(built.coalesce(1), keys))


def test_snapping_broadcasts_neither_points_nor_exploded_legs(spark):
    """Their sizes are far above what small files let expect; equal places are measured once."""
    from trenchline.operators import network

    segments = spark.createDataFrame(
        [("p", "s", [(30.0, -96.0), (30.0, -95.999)], [0.0, 315.0], 315.0, True)],
        "project_id string, segment_id string, coords array<struct<lat:double,lon:double>>, chain array<double>, length_ft double, eligible boolean")
    points = spark.createDataFrame([("p", n, 30.0 + n % 2 * 1e-4, -95.9995) for n in range(6)], "project_id string, photo_id long, lat double, lon double")
    snapped = network.snap(points, segments, "photo_id")
    assert "BroadcastHashJoin" not in snapped._jdf.queryExecution().executedPlan().toString()
    rows = network.with_route_offset(snapped, segments, "photo_id").collect()
    assert sorted(r.photo_id for r in rows) == list(range(6))
    assert len({(r.distance_ft, r.route_offset_ft) for r in rows}) == 2


def test_windows_of_a_route_are_made_once_for_groups_of_one_span(monkeypatch):
    import numpy as np
    import pandas as pd

    from trenchline.operators import windows
    from trenchline.operators.intervals import Claims
    from trenchline.operators.ownership import _options

    made, make = [], windows.make_windows
    monkeypatch.setattr(windows, "make_windows", lambda line, span: made.append(span) or make(line, span))
    n, chain = 20, np.linspace(0.0, 1500.0, 26)
    flat = pd.Series([np.zeros(26)] * n)
    rel = pd.Series([np.array([0.0, 100.0 + k % 3, 300.0 + 25 * (k % 2)]) for k in range(n)])
    span = pd.Series([x[-1] for x in rel])
    none = pd.Series([None] * n)
    found = windows.best_window.func(pd.Series([chain] * n), flat, flat, rel, span, none, none)
    assert len(found) == n and sorted(made) == [300.0, 325.0]
    made.clear()
    claims, hyp = Claims(), {"chain": list(chain), "route_sheets": None, "start_ft": 0.0, "end_ft": 300.0}
    first = _options(hyp, [0.0, 300.0], 300.0, None, claims.lines)
    again = _options(hyp, [0.0, 300.0], 300.0, None, claims.lines)
    assert made == [300.0] and all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))


def test_outline_groups_follow_partitions(spark):
    """A project that lies in one partition is one group of the middle step, not one for each salt."""
    from trenchline.operators import hulls

    points = spark.createDataFrame([("p", x / 10, y / 10) for x in range(12) for y in range(12)], "project_id string, lon double, lat double").coalesce(1)
    outline = hulls.design_outline(points)
    plan = outline._jdf.queryExecution().analyzed().toString()
    assert "spark_partition_id" in plan.lower() and "xxhash64" not in plan.lower()
    assert {(r.lon, r.lat) for r in outline.collect()} == {(0.0, 0.0), (1.1, 0.0), (1.1, 1.1), (0.0, 1.1)}


def test_pieces_by_bounds_are_those_of_locate():
    from trenchline.operators.windows import Line

    rng = np.random.default_rng(3)
    for _ in range(20):
        line = Line(np.concatenate([[0.0], np.cumsum(rng.choice([0.0, 7.3, 60.0, 119.99999, 181.0, 1e-10], 12))]))
        near = np.concatenate([np.nextafter(line.bounds, -np.inf), line.bounds, np.nextafter(line.bounds, np.inf)])
        feet = np.concatenate([near, rng.uniform(-50, line.total + 50, 300), line.chain])
        assert np.array_equal(line.piece(feet), line.locate(feet)[2])


def test_best_window_is_the_best_of_all_windows():
    """Bounds skip windows, never the best one; rows of any route may stand in one call, some without length."""
    import pyarrow as pa

    from trenchline.operators import windows

    rng = np.random.default_rng(5)
    chains = [np.concatenate([[0.0], np.cumsum(rng.uniform(20, 150, 14))]) for _ in range(4)] + [np.zeros(2)]
    rows = [(chains[k % 5], np.unique(np.round(rng.uniform(0, 400, 9) / 25) * 25), [1 + k % 3] if k % 2 else None, [1, 2, 3] if k % 3 else None) for k in range(60)]
    rows = [(c, x - x[0], float(x[-1] - x[0]), gs, rs) for c, x, gs, rs in rows]
    doubles, ints = pa.list_(pa.float64()), pa.list_(pa.int32())
    chain = pa.array([c for c, *_ in rows], doubles)
    found = windows.best_window.func(chain, chain, chain, pa.array([x for _, x, *_ in rows], doubles), pa.array([s for _, _, s, *_ in rows]),
                                     pa.array([r[3] for r in rows], ints), pa.array([r[4] for r in rows], ints)).to_pylist()
    for (c, x, s, gs, rs), got in zip(rows, found, strict=True):
        if c[-1] == 0:
            assert (got["window_type"], got["n_windows"], got["p_piece"]) == (None, 0, [])
            continue
        line, start, end, _, score, bias = scored_windows(c, x, s, sheet_fractions(gs, rs))
        k = np.lexsort((start, np.abs(np.abs(end - start) - s), -bias, -score))[0]
        assert (got["start_ft"], got["window_score"], got["bias"]) == (half_up(start[k], 2), score[k], bias[k])
        assert got["p_piece"] == line.locate(start[k] + x)[2].tolist() and got["n_windows"] == len(start)


def test_anchored_routes_are_kept_as_columns(job):
    """Wide rows in the checkpoint folder filled the disk: later steps read columns, and stations come without their texts."""
    plan = job.anchored.select("route_id", "start_ft")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "station_rows" not in plan
    assert job.anchored.schema["station_rows"].dataType.elementType.names == ["station_ft"]


def test_settled_claims_are_kept_as_columns(job):
    """Copies of whole claims in every round filled the disk; a task walks all its routes in one pass, without a call for each."""
    for table in (job.evaluated, job.claims, job.owned):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert not {"coords", "p_lat", "mapped"} & set(job.evaluated.columns)


def test_places_inside_pieces_are_those_of_parts():
    from trenchline.operators.windows import Line

    rng = np.random.default_rng(6)
    for _ in range(20):
        line = Line(np.concatenate([[0.0], np.cumsum(rng.choice([0.0, 7.3, 60.0, 119.99999, 181.0, 1e-10], 12))]))
        bounds, piece, inside = line.inner()
        feet = np.concatenate([np.nextafter(bounds, -np.inf), bounds, np.nextafter(bounds, np.inf), rng.uniform(0, line.total, 300), line.chain, [-5.0, line.total + 5]])
        seg, ratio, n, part = line.parts(feet)
        local = (ratio - part / n) * n
        place = np.searchsorted(bounds, np.minimum(feet, line.total))
        assert np.array_equal(piece[place], line.first[seg] + part)
        assert np.array_equal(inside[place], (local >= 0.08) & (local <= 0.92))


def test_best_start_is_the_best_of_all_starts(monkeypatch):
    """Bounds leave out most starts of a long route, never the best one."""
    import pandas as pd

    from trenchline.operators import anchors

    rng, rows = np.random.default_rng(7), []
    for _ in range(40):
        chain = np.concatenate([[0.0], np.cumsum(rng.uniform(20, 150, 16))])
        rel = np.unique(np.round(rng.uniform(0, 500, 11) / 25) * 25)
        rows.append((chain, rng.uniform(30, 30.01, 17), np.linspace(-96, -95.99, 17), rel - rel[0], float(rel[-1] - rel[0]), float(rel[0]), float(rel[-1]), 0.7))
    columns = [pd.Series(list(c)) for c in zip(*rows, strict=True)]
    laid, real = [], anchors.score_starts
    monkeypatch.setattr(anchors, "score_starts", lambda *a: laid.append(len((got := real(*a))["start"])) or got)
    bounded = anchors.best_anchor.func(*columns)
    monkeypatch.setattr(anchors, "_FIRST", 10 ** 6)
    assert bounded.equals(anchors.best_anchor.func(*columns))
    assert sum(laid[:len(laid) // 2]) < sum(laid[len(laid) // 2:]) * 0.7
